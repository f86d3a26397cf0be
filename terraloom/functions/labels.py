"""Report texts. All strings below are fixed values that exports must reproduce."""

RECOMMENDATIONS = {  # by score class: action, follow-up, priority, cost, timeline
    "high": (
        "Ground verification expedition required immediately",
        "Detailed archaeological survey and excavation planning",
        "CRITICAL - Highest priority",
        "$50,000-80,000 USD for initial verification",
        "30-60 days for ground team deployment",
    ),
    "probable": (
        "Acquire high-resolution satellite imagery and LiDAR if available",
        "Ground reconnaissance mission to confirm features",
        "HIGH - Second priority",
        "$25,000-40,000 USD for verification",
        "60-90 days for detailed remote sensing + ground visit",
    ),
    "possible": (
        "Additional remote sensing analysis with different seasons",
        "Monitor for additional evidence before ground verification",
        "MEDIUM - Third priority",
        "$5,000-15,000 USD for enhanced analysis",
        "3-6 months for additional remote sensing",
    ),
    "natural": (
        "Continue routine monitoring",
        "Re-evaluate with improved detection methods",
        "LOW - Background monitoring",
        "$1,000-5,000 USD for periodic review",
        "6-12 months for next evaluation",
    ),
}
RECOMMENDATION_FIELDS = ("immediate_action", "follow_up", "priority_level", "estimated_cost", "timeline")

ACADEMIC_ACTION = {
    "EXCEPTIONAL": "IMMEDIATE PUBLICATION - Exceptional statistical evidence warrants peer-review submission",
    "HIGH": "GROUND VERIFICATION - Results meet academic standards for field validation",
    "MEDIUM": "ADDITIONAL ANALYSIS - Collect more data to reach publication threshold",
    "LOW": "INSUFFICIENT EVIDENCE - Results below academic publication standards",
}
JOURNALS = {
    "exceptional": [
        "Proceedings of the National Academy of Sciences (PNAS)", "Nature Archaeology", "Antiquity",
        "Journal of Archaeological Science",
    ],
    "standard": ["Journal of Archaeological Science", "Antiquity", "Archaeological Prospection", "Remote Sensing"],
    "other": ["Archaeological Prospection", "Remote Sensing", "ISPRS Journal of Photogrammetry and Remote Sensing"],
}

LIDAR_TEXT = {
    "clearing": (
        (100000, "Large settlement complex with multiple residential areas"),
        (50000, "Medium settlement site with organized layout"),
        (10000, "Small settlement or household cluster"),
        (None, "Individual structure or clearing"),
    ),
    "mound": ((5000, "Large ceremonial or defensive earthwork"), (None, "Small mound or platform structure")),
    "other": "Unidentified archaeological feature",
}
SPECTRAL_TEXT = {
    "terra_preta": (
        (50000, "Large terra preta deposit indicating major settlement complex"),
        (10000, "Medium terra preta deposit suggesting organized residential area"),
        (None, "Small terra preta patch indicating household or specialized activity area"),
    ),
    "geometric": {
        "circle": "Circular vegetation pattern suggesting plaza or ceremonial area",
        "rectangle": "Rectangular pattern indicating structured settlement layout",
        "line": "Linear feature suggesting pathway, canal, or defensive structure",
        "": "Geometric pattern indicating human landscape modification",
    },
    "crop_mark": "Subsurface archaeological feature visible through differential vegetation growth",
    "other": (
        (0.7, "High-confidence spectral anomaly consistent with archaeological site"),
        (0.5, "Moderate-confidence vegetation stress pattern suggesting human activity"),
        (None, "Low-confidence spectral anomaly requiring further investigation"),
    ),
}
PRIORITY_TEXT = (
    (80, "Immediate - High priority investigation site"),
    (60, "High - Priority investigation within 6 months"),
    (40, "Medium - Investigation within 1 year"),
    (None, "Low - Research interest, long-term investigation"),
)

SEASONS = {
    "upano_valley_confirmed": "May-September (dry season, river access)",
    "trombetas": "June-November (low water, better helicopter access)",
    "upper_napo_micro": "July-October (minimal rainfall, river navigable)",
    "": "June-September (general dry season recommendation)",
}
ACCESS = {
    "upano_valley_confirmed": "Moderate - River access possible, helicopter recommended",
    "trombetas": "Difficult - Remote location, helicopter required",
    "upper_napo_micro": "Moderate - River transport feasible",
    "": "Remote - Helicopter or extended river journey required",
}
LOGISTICS = {
    "upano_valley_confirmed": "Medium - River transport + short hike",
    "trombetas": "High - Helicopter required, remote location",
    "upper_napo_micro": "Medium - River transport feasible",
    "": "High - Remote location",
}
SAFETY_COMMON = [
    "Tropical disease precautions (malaria, dengue)", "Emergency communication devices",
    "First aid kit with snake bite treatment", "Water purification system", "Emergency evacuation plan",
]
SAFETY = {
    "upano_valley_confirmed": ["River safety equipment", "Landslide awareness in rainy season"],
    "trombetas": ["Isolated location - medical evacuation critical", "Wildlife encounters (jaguars, snakes)"],
    "upper_napo_micro": ["Border area security considerations", "River current safety"],
}
PERMITS_COMMON = [
    "INPC archaeological research permit", "Environmental impact assessment", "Local community consultation",
]
PERMITS = {
    "upano_valley_confirmed": ["Regional government coordination"],
    "trombetas": ["Protected area access permit"],
    "upper_napo_micro": ["Border area clearance"],
}
EQUIPMENT_COMMON = [
    "GPS with sub-meter accuracy", "Ground-penetrating radar (GPR)", "Soil auger for core sampling",
    "Portable XRF for soil analysis", "High-resolution camera with macro lens", "Measuring tapes (30m, 100m)",
    "Archaeological field forms", "Sample bags and labels",
]
EQUIPMENT_SOIL = ["Soil pH testing kit", "Phosphorus field test kit", "Charcoal identification guide"]
EQUIPMENT_GEOMETRIC = ["Total station or theodolite", "Measuring wheel", "Archaeological grid stakes"]
EQUIPMENT_LARGE = ["Drone with LiDAR", "RTK GPS base station", "Multi-spectral camera"]

READINESS = (
    "High - Ready for peer review", "Medium - Additional validation recommended",
    "Low - Requires field verification", "Not ready - Insufficient confidence",
)
SIGNIFICANCE = (
    "Very High - Major archaeological discovery potential", "High - Significant settlement complex",
    "Medium-High - Strong detection confidence", "Medium - Notable archaeological feature",
    "Standard - Typical archaeological interest",
)
CITATIONS = (
    "High citation potential (50+ citations expected)", "Good citation potential (20-50 citations expected)",
    "Moderate citation potential (10-20 citations expected)", "Standard citation potential (5-10 citations expected)",
)
COMPLETENESS = (
    "Complete - All major data components present", "Good - Most data components present",
    "Incomplete - Additional data collection needed",
)
ZONE_ACTION = (
    "🎯 IMMEDIATE GROUND VERIFICATION - High confidence archaeological site",
    "📡 HIGH-RESOLUTION IMAGERY + GROUND RECONNAISSANCE",
    "🔄 Additional remote sensing analysis recommended",
    "📊 Continue monitoring with different seasonal imagery",
)
ACCESS_DIFFICULTY = (
    "High - Remote headwater region, requires river transport",
    "Medium - River access possible, some overland travel",
    "Medium - Standard Amazon access challenges",
)
