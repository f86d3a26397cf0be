"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (e-mail, IP, card, phone) are the seeds. Every seed induces lexical patterns: its kind, its written
shape and the word before it, and the same with any word before. Candidates are runs of one to four neighbouring tokens
with digits or an at sign that the base rules left. Patterns and candidate values form a bipartite graph. In each round a pattern's
confidence is the score of the distinct values it extracts over their number, and a value's score is the noisy-or of its
confident patterns; values that reach the threshold count as known in the next round. Candidates whose best pattern is confident become spans.

Positions count code points, the end is exclusive. Null and empty texts have no spans. Equal rows get equal results, each
its own row. An empty table gives an empty result. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import saved, whole_text
from terraloom.llm.registry import query, table

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns, written with possessive loops and a look-behind, so that a run of any length is read once. A
#: local part may also start where the last match ended (\G), as a plain scan from left to right would find it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Ends of a token that are not part of a value.
HEAD, TAIL = r"^[\"'<\[{]+", r"[.,;:!?\"'>\]}]+$"
SPAN = "array<struct<s:int,e:int,v:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x.v)


def _labelled(label: Column, spans: str, *names: str) -> Column:
    """The spans of a column as structs of a label and the named fields."""
    return F.transform(spans, lambda x: F.struct(label, *[x[n].alias(n) for n in names]))


def _located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value): the texts between them, from the same scan rule, give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
        lambda gap, v: F.struct(F.length(gap).alias("g"), F.length(v).alias("n"), v.alias("v")),
    )
    start = F.struct(F.lit(0).alias("p"), F.array().cast(SPAN).alias("o"))
    located = F.aggregate(
        steps, start,
        lambda a, x: F.struct(
            (a.p + x.g + x.n).alias("p"),
            F.concat(a.o, F.array(F.struct((a.p + x.g).alias("s"), (a.p + x.g + x.n).alias("e"), x.v.alias("v")))).alias("o"),
        ),
        lambda a: a.o,
    )
    return F.when(F.size(found) > 0, located).otherwise(F.array().cast(SPAN))


def _shape(value: Column) -> Column:
    """Digits as 9 and runs of letters as one a, so that values written alike share a shape."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}+", "a")


def _word_before(gap: Column) -> Column:
    """Last word of the text that ends where a value begins; ^ at the start of the text or after another candidate."""
    near = F.rtrim(F.translate(F.substring(gap, -96, 96), "\t\n\x0b\x0c\r", "     "))
    return F.when(near == "", "^").otherwise(F.lower(F.substring_index(near, " ", -1)))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: base spans per kind, and the located tokens with the word before each."""
    text = F.col("t")
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t")).withColumn(
        "any", text.rlike("[0-9@]")
    )
    need = {"email": F.contains(text, F.lit("@")), "ip": F.col("any"), "card": F.col("any"), "phone": F.contains(text, F.lit("+"))}
    cols = [
        F.when(need[k], F.filter(_located(text, PATTERNS[k]), _checked(k))).otherwise(F.array().cast(SPAN)).alias(k)
        for k in KINDS
    ]
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    tokens = F.when(
        F.col("any"),
        F.zip_with(
            F.slice(F.split(text, TOKEN, -1), F.lit(1), F.size(found)), found,
            lambda gap, v: F.struct(F.length(gap).alias("gap"), _word_before(gap).alias("left"), v.alias("v")),
        ),
    )
    return saved(base.select("doc_id", *cols, tokens.alias("tokens")).withColumn("row", F.monotonically_increasing_id()), "scanned")


def _candidates(scanned: DataFrame) -> DataFrame:
    """Runs of one to four neighbouring tokens as (row, s, e, value, shape, left), without those that touch a base span."""
    # many tokens in one text are spread by the sum over (row, position), which Spark sorts and spills
    tok = scanned.where(F.size("tokens") > 0).select("row", F.posexplode("tokens").alias("i", "t"))
    order = Window.partitionBy("row").orderBy("i")
    end = F.sum(F.col("t.gap") + F.length("t.v")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    tok = tok.select("row", "i", "t", end.alias("end"))
    runs = tok.select(
        "row", "i", (F.col("end") - F.length("t.v")).alias("start"), F.col("t.left").alias("left"), F.col("t.v").alias("v0"),
        *[F.when(F.lead("t.gap", k).over(order) == 1, F.lead("t.v", k).over(order)).alias(f"v{k}") for k in (1, 2, 3)],
    )
    grown = [F.col("v0")]
    for k in (1, 2, 3):  # null as soon as one token is not a neighbour
        grown.append(F.concat(grown[-1], F.lit(" "), F.col(f"v{k}")))
    flat = runs.select("row", "start", "left", F.explode(F.array_compact(F.array(*grown))).alias("raw"))
    head, tail = F.length(F.regexp_extract("raw", HEAD, 0)), F.length(F.regexp_extract("raw", TAIL, 0))
    flat = flat.select(
        "row", "left", (F.col("start") + head).alias("s"), (F.col("start") + F.length("raw") - tail).alias("e"),
        F.substring(F.col("raw"), head + 1, F.length("raw") - head - tail).alias("value"),
    ).where("s < e")
    known = scanned.select("row", F.concat(*KINDS).alias("known")).where(F.size("known") > 0)
    flat = flat.join(known, "row", "left")
    touches = F.exists("known", lambda k: (k.s < F.col("e")) & (k.e > F.col("s")))
    return flat.where(~F.coalesce(touches, F.lit(False))).select("row", "s", "e", "value", _shape(F.col("value")).alias("shape"), "left")


def _seeds(scanned: DataFrame) -> DataFrame:
    """(kind, value, shape, left) of the base spans; the word before comes from the token the span starts in."""
    kinds = F.concat(*[_labelled(F.lit(k).alias("kind"), k, "s", "v") for k in KINDS])
    one = scanned.select("row", F.explode(kinds).alias("x")).select("row", "x.*")
    tok = scanned.where(F.size("tokens") > 0).select("row", F.posexplode("tokens").alias("i", "t"))
    order = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tok = tok.select("row", F.sum(F.col("t.gap") + F.length("t.v")).over(order).alias("end"), F.length("t.v").alias("n"), F.col("t.left").alias("left"))
    at = F.col("end") - F.col("n")
    return one.join(tok, "row").where((F.col("s") >= at) & (F.col("s") < F.col("end"))).select(
        "kind", F.col("v").alias("value"), _shape(F.col("v")).alias("shape"), "left"
    )


def discovered(
    scanned: DataFrame, rounds: int = 3, confidence: float = 0.9, support: float = 5.0
) -> DataFrame:
    """(row, kind, s, e) of candidates that confident patterns extract.

    ``support`` is the least score sum of a pattern's values, ``confidence`` the least share of it in all its values.
    """
    seeds = _seeds(scanned).distinct()
    cand = saved(_candidates(scanned), "candidates")
    shapes = seeds.select("shape", "kind").distinct()
    # graph edges between patterns (kind, shape, left) and values; seeds carry score 1
    open_edges = cand.select("value", "shape", "left").distinct().join(shapes, "shape").select("kind", "value", "shape", "left", F.lit(False).alias("seed"))
    edges = seeds.select("kind", "value", "shape", "left", F.lit(True).alias("seed")).unionByName(open_edges)
    edges = edges.withColumn("left", F.explode(F.array("left", F.lit("*")))).distinct()
    edges = saved(edges, "edges")
    known = None
    patterns = None
    for _ in range(rounds):
        scored = edges.withColumn("score", F.col("seed").cast("double"))
        if known is not None:
            scored = scored.join(known, ["kind", "value"], "left").withColumn("score", F.greatest("score", F.coalesce("p", F.lit(0.0)))).drop("p")
        # a value written twice under one pattern counts once: edges are distinct
        patterns = (
            scored.groupBy("kind", "shape", "left").agg(F.sum("score").alias("f"), F.count(F.lit(1)).alias("n"))
            .select("kind", "shape", "left", "f", (F.col("f") / F.col("n")).alias("conf"))
            .where((F.col("f") >= support) & (F.col("conf") >= confidence))
        )
        patterns = saved(patterns, "patterns")
        hits = edges.where("not seed").join(patterns, ["kind", "shape", "left"])
        known = (
            hits.groupBy("kind", "value").agg((F.lit(1.0) - F.exp(F.sum(F.log(F.greatest(F.lit(1.0) - F.col("conf"), F.lit(1e-9)))))).alias("p"))
            .where(F.col("p") >= confidence)
        )
        known = saved(known, "known")
    best = (
        cand.join(known, "value").join(shapes, ["shape", "kind"])
        .groupBy("row", "s", "e").agg(F.max_by("kind", F.struct("p", "kind")).alias("kind"))
    )
    # of overlapping candidates the leftmost, then the longest, stays
    before = Window.partitionBy("row").orderBy("s", F.col("e").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_reach", F.max("e").over(before)).where("_reach is null or s >= _reach").select("row", "kind", "s", "e")


def find_private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, email, ip, card, phone, added): base spans by kind and discovered ones, each an array of (s, e).

    ``added`` holds (kind, s, e). One row per input row.
    """
    scanned = _scanned(docs, id_col, text_col)
    new = discovered(scanned, **options).groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added"))
    strip = [F.transform(k, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))).alias(k) for k in KINDS]
    return scanned.join(new, "row", "left").select("doc_id", *strip, "added")


def _joined(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined; ``spans`` are structs (o, s, e)."""
    text = F.transform(
        F.array_sort(spans),
        lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.o + 1), x.s.cast("string"), x.e.cast("string")),
    )
    return F.array_join(text, ",")


@query("op1_pii")
def op1_pii(spark, sf_dir):
    """Contract query: counts and digest of the base spans, all spans as text, number of discovered spans."""
    found = find_private_spans(table(spark, sf_dir, "documents"))
    ordered = [_labelled(F.lit(o).alias("o"), k, "s", "e") for o, k in enumerate(KINDS)]
    order = F.create_map(*[x for o, k in enumerate(KINDS) for x in (F.lit(k), F.lit(o))])
    extra = F.transform(
        F.coalesce("added", F.array().cast("array<struct<kind:string,s:int,e:int>>")),
        lambda x: F.struct(order[x.kind].alias("o"), x.s.alias("s"), x.e.alias("e")),
    )
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.concat(*ordered)), 256).alias("base_sha256"), _joined(F.concat(*ordered, extra)).alias("spans"),
        F.size(extra).cast("long").alias("n_added"),
    )
