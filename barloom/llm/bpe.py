"""BPE encoding through a table of distinct words, and decoding through the table of pieces.

Encoding, in four steps:

1. Documents are dealt to blocks of about ``BLOCK_CHARS`` characters, and packed.
2. Each block is split into words; its distinct words go to the word table, which is dealt to ranges by a hash of the
   word: all blocks' copies of a word meet in one range, and each distinct word is encoded once (of a corpus of more than
   SHARE blocks, about 24 GB, each share has its own table, so that no frequent word gathers entries without bound).
3. The ids go back to the blocks that have the words, in the order in which the words came (an entry a word and block,
   never one a position).
4. Each block puts the ids in place of its words, by position.

Words and ids travel packed, a row a block and range, so the shuffles are a fraction of the text.

A word is a run between spaces and line feeds, both of which the tokenizer always drops and never looks across; where
a word is Latin letters followed by ASCII marks, it is cut there (another boundary that the tokenizer always has) and
the letters are lower-cased, which keeps the word table small. Every other word is given to the tokenizer as it is,
special tokens and unusual white space included, so encoding by words equals encoding the whole text.

Decoding looks every id up in the id-to-piece table. That table has one row an id of the vocabulary and does not grow
with the data (``MAX_VOCABULARY`` is checked), so the join is done map-side: the table is a constant of the plan and
pieces are taken from it by position, without moving a row.

Defined cases: null and empty text give no ids and decode to the empty text; a null list of ids decodes to the empty
text; repeated rows are encoded each; a null id of a document is passed through; ids outside the vocabulary decode to
nothing; an empty table gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.blocks import batches_of, pack, texts_of
from barloom.llm.common import parallelism, table

BLOCK_CHARS = 6_000_000
SHARE = 4096
MAX_VOCABULARY = 1_000_000
DEFAULT_FILE = "word_bpe_49k.json"

_CUT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def vocabulary_file(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(run: str) -> tuple[str, ...]:
    """What the word table has for a run between spaces."""
    if run.isascii() and run.isalpha():
        return (run.lower(),)
    cut = _CUT.fullmatch(run)
    if cut is None:
        return (run,)
    return tuple(x for x in (cut[1].lower(), cut[2]) if x)


def runs_of(text: str | None) -> list[str]:
    return (text or "").replace("\n", " ").split(" ")


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: the id column and ids array<int>."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(_read(path or vocabulary_file()))
    packed, n_blocks = pack(docs, id_col, text_col, block_chars)
    # a share of SHARE blocks has a word table of its own, in ranges of about 8 blocks' words: bounded groups, however
    # many blocks have a word, and as many rows as blocks
    ranges = max(-(-parallelism(spark) // -(-n_blocks // SHARE)), min(n_blocks, SHARE) // 8, 1)
    id_type = docs.schema[id_col].dataType

    def words(key, block):
        share = key[0].as_py() // SHARE * ranges
        rows = [(share + to, _zip("\n".join(own).encode())) for to, own in _dealt(_distinct(_pieces(block)), ranges)]
        return pa.table({"to": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "words": pa.array([r[1] for r in rows], pa.binary())})

    def ids_of(key, table_):
        lists = [_unzip(x.as_py()).decode().split("\n") for x in table_.column("words")]
        tok, ids = _tokenizer(spec.value), {}
        every = sorted(set(chain.from_iterable(lists)))
        for k in range(0, len(every), 20_000):
            some = every[k : k + 20_000]
            ids.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(some, tok.encode_batch(some, add_special_tokens=False), strict=True))
        out = []
        for own in lists:
            found = [ids[w] for w in own]
            sizes = np.array([len(x) // 4 for x in found], np.int32)
            out.append(_zip(sizes.tobytes() + b"".join(found)))
        return pa.table({"block": table_.column("block"), "to": table_.column("to"), "ids": pa.array(out, pa.binary())})

    def put(key, coded, block):
        known = dict(zip(coded.column("to").to_pylist(), coded.column("ids").to_pylist(), strict=True))
        share = key[0].as_py() // SHARE * ranges
        ids: dict[str, bytes] = {}
        pieces = _pieces(block)
        for to, own in _dealt(_distinct(pieces), ranges):
            flat = _unzip(known[share + to])
            ends = (4 * (np.cumsum(np.frombuffer(flat, np.int32, len(own))) + len(own))).tolist()
            ids.update((w, flat[a:b]) for w, a, b in zip(own, [4 * len(own), *ends[:-1]], ends, strict=True))
        runs = {r: ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for r, p in pieces.items()}
        done, out, ends = [], [], [0]
        for docs_ in batches_of(block):
            done.append(docs_.column("id"))
            for text in docs_.column("text").to_pylist():
                out.append(b"".join(map(runs.__getitem__, runs_of(text))))
                ends.append(ends[-1] + len(out[-1]) // 4)
        flat = pa.array(np.frombuffer(b"".join(out), np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.table({"id": pa.concat_arrays(done), "ids": lists})

    table_ = packed.groupBy("block").applyInArrow(words, "to int, block int, words binary")
    coded = table_.groupBy("to").applyInArrow(ids_of, "block int, to int, ids binary")
    done = coded.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(put, f"id {id_type.simpleString()}, ids array<int>")
    return done.withColumnRenamed("id", id_col)


def _zip(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(x)


def _unzip(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _pieces(block: pa.Table) -> dict[str, tuple[str, ...]]:
    """The pieces of each distinct run of a block."""
    runs: set[str] = set()
    for text in texts_of(block):
        runs.update(runs_of(text))
    return {r: pieces_of(r) for r in runs}


def _distinct(pieces: dict[str, tuple[str, ...]]) -> list[str]:
    """The distinct words among them, in order."""
    return sorted({p for own in pieces.values() for p in own})


def _dealt(words: list[str], ranges: int):
    """(range, its words in order): a word is always in the same range."""
    to = np.array([crc32(w.encode()) % ranges for w in words], np.int64)
    order = np.argsort(to, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(own):
            yield int(to[own[0]]), [words[k] for k in own.tolist()]


def piece_table(path: str | None = None) -> list[str]:
    """The pieces by id; '' where there is none."""
    spec = json.loads(_read(path or vocabulary_file()))
    ids = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    if len(ids) > MAX_VOCABULARY or any("\n" in p for p in ids.values()):
        raise ValueError("not a vocabulary that decode() can join map-side")
    return [ids.get(i, "") for i in range(max(ids) + 1)]


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: their pieces, joined by one space (the vocabulary names no decoder)."""
    pieces = F.split(F.lit("\n".join(piece_table(path))), "\n")
    return F.coalesce(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), " "), F.lit(""))


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    return encoded.withColumn(text_col, decoded(F.col(ids_col), path))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    both = decode(encode(docs))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
