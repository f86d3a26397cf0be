"""Token ids as flat unsigned integer files with 64-bit document offsets, read back through memory maps.

Documents are range-partitioned and sorted by id (null ids last). Each task encodes its texts and streams one ``.bin`` of ids (16 bits each while the vocabulary allows, else 32),
one ``.idx`` of 64-bit offsets (one more than documents) and one ``.doc`` of 64-bit document ids (with a ``.nul`` byte each). A manifest with one row per file gives the
position of every file in the whole sequence by prefix sums. File names carry a random part, and only names in the manifest are read, so a task that ran twice
leaves a stray file but no double rows.

The tokenizer's file is a parameter; its contents are sent to the tasks. Where its definition lets white space end every token (``splits_at_spaces``), a text's ids are the ids of its space-separated
pieces in order: each distinct piece of a slice is encoded once by the library and kept in a cache of bounded size, which belongs to the worker process and outlives its tasks. With any other tokenizer
the library encodes whole texts.

Null and empty texts give the end id alone. Rows with equal ids stand in any order among themselves. An empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import held, saved, shared_folder, slices, whole_text
from terraloom.llm.registry import query, table

CACHE = 600_000
END = 1


def _storage(path: str):
    """(file system, path) of a folder given as a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: The word pattern of the vocabulary this was made for (a fixed value): none of its tokens holds white space, and a letter is never in one token with a stop.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(definition: str) -> tuple[bool, bool]:
    """(whether pieces between white space can be encoded by themselves, whether letters are folded) by a tokenizer's definition."""
    d = json.loads(definition)
    flat = lambda x, many: [] if not x else x[many] if x["type"] == "Sequence" else [x]
    normal, pre = flat(d.get("normalizer"), "normalizers"), flat(d.get("pre_tokenizer"), "pretokenizers")
    spaces = [x for x in normal if x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "]
    known = all(x["type"] in ("NFC", "Lowercase") or x in spaces for x in normal)
    cut = bool(pre) and pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": WORDS} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    cut = cut and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in pre[1:])
    names = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"])) for t in d.get("added_tokens", []))
    whole = d["model"].get("dropout") is None
    return known and cut and names and whole, any(x["type"] == "Lowercase" for x in normal)


def stem_of(piece: str, fold: bool) -> str:
    """The piece without full stops and commas after an ASCII letter, which the vocabulary encodes on their own, and in ASCII pieces with A-Z folded if it folds.

    Pieces that could hold the name of an added token stay as they are.
    """
    if "<" in piece:
        return piece
    folded = piece.lower() if fold and piece.isascii() else piece
    stem = folded.rstrip(".,")
    return stem if stem and stem[-1].isascii() and stem[-1].isalpha() else folded


class Encoder:
    """Ids of texts by the library, one call for the stems that are not in the cache."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_pieces, self.fold = splits_at_spaces(definition)
        self.cache: dict[str, bytes] = {}

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end id after each; number per text)."""
        if not self.by_pieces:
            made = [np.array([*e.ids, END], "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([*made, np.zeros(0, "<u4")]), np.array([len(m) for m in made], np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = split.flatten().dictionary_encode()
        words = pieces.dictionary.to_pylist()
        codes = pieces.indices.to_numpy()
        cache = self.cache
        known = [cache.get(w) for w in words]
        missing = [i for i, k in enumerate(known) if k is None]
        stems = {i: stem_of(words[i], self.fold) for i in missing}
        tails = {i: words[i][len(s):] for i, s in stems.items()}
        new = list({x for x in (*stems.values(), *tails.values()) if x and x not in cache})
        made = {}
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else []):
            made[x] = np.array(e.ids, "<u4").tobytes()
            if len(cache) < CACHE:
                cache[x] = made[x]
        for i, stem in stems.items():
            found = made.get(stem) or cache.get(stem, b"")
            tail = tails[i]
            known[i] = found + (made.get(tail) or cache.get(tail, b"")) if tail else found
        flat = np.frombuffer(b"".join(known), "<u4") if known else np.zeros(0, "<u4")
        size = np.array([len(k) // 4 for k in known], np.int64)
        first = np.cumsum(size) - size
        # the end id is one more piece after each text
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(per_text)
        flat, first, size = np.append(flat, np.uint32(END)), np.append(first, len(flat)), np.append(size, 1)
        codes = np.insert(codes, ends, len(size) - 1)
        n = size[codes]
        out = flat[np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate([[0], np.cumsum(n)])
        stop = total[ends + np.arange(1, len(ends) + 1)]
        return out, np.diff(np.concatenate([[0], stop]))


def encoder_of(definition: str) -> Encoder:
    """The one encoder of this worker process for a tokenizer."""
    return held(hashlib.sha256(definition.encode()).hexdigest(), lambda: Encoder(definition))


def vocabulary_size(definition: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, definition: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below ``folder`` and return the manifest (part, file, width, docs, tokens, base).

    ``definition`` is the text of a tokenizer file; ``base`` is the number of ids in all files before.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    width = 2 if vocabulary_size(definition) <= 1 << 16 else 4

    def write(batches):
        part = TaskContext.get().partitionId()
        store, root = _storage(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        encoder, lengths, ids = None, [], []
        out = None
        for b in batches:
            for s in slices(b, "text"):
                encoder = encoder or encoder_of(shared.value)
                out = out or store.open_output_stream(f"{root}/{name}.bin")
                flat, n = encoder.ids(s.column(1))
                out.write(flat.astype(f"<u{width}").tobytes())
                lengths.append(n)
                ids.append(s.column(0))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
        keys = pa.chunked_array(ids).combine_chunks()
        nul = np.asarray(keys.is_null().to_numpy(zero_copy_only=False), np.uint8)
        for suffix, data in ((".idx", offsets), (".doc", keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")), (".nul", nul)):
            with store.open_output_stream(f"{root}/{name}{suffix}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "width": pa.array([width], pa.int32()), "docs": [len(nul)], "tokens": [int(offsets[-1])]}
        )

    order = F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    manifest = saved(ranged.mapInArrow(write, "part int, file string, width int, docs long, tokens long"), "manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


def open_tokens(file: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids, null marks) of one file, memory-mapped where the store is a local or mounted folder."""
    from pyarrow import fs

    store, path = _storage(file)

    def load(suffix: str, kind: str) -> np.ndarray:
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path + suffix, kind, "r")
        with store.open_input_file(path + suffix) as f:
            return np.frombuffer(f.read(), kind)

    return load(".bin", f"<u{width}"), load(".idx", "<u8"), load(".doc", "<i8"), load(".nul", "u1")


def read_tokens(manifest: DataFrame, rows: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files, a file per task."""

    def read(batches):
        for b in batches:
            for m in b.to_pylist():
                ids, offsets, doc, nul = open_tokens(m["file"], m["width"])
                offsets = offsets.astype(np.int64)
                for a in range(0, len(doc), rows):
                    z = min(a + rows, len(doc))
                    part = np.asarray(ids[offsets[a]: offsets[z]], "<u4")
                    at = (offsets[a: z + 1] - offsets[a]).tolist()
                    crc = [zlib.crc32(part[s:e]) for s, e in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(doc[a:z]), pa.int64(), mask=np.array(nul[a:z], bool)), pa.array(offsets[a:z] + m["base"]), pa.array(np.diff(offsets[a: z + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.select("file", "width", "base").repartition("file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) with the tokenizer file at ``tokenizer`` and return what the files hold per document."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    return read_tokens(write_tokens(docs, definition, folder or shared_folder(docs.sparkSession, "tokens")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    """Contract query: whole texts, end id 1, ascending doc_id."""
    return encoded(table(spark, sf_dir, "documents"), default_tokenizer())
