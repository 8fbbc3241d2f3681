"""Byte-level BPE encoding of a whole corpus with a public tokenizer's merge table (problem 6).

Spark cuts each text into pre-tokens with a built-in regular expression. Every task then holds its own DuckDB connection
with the merge table: the distinct words of a batch become token-position rows, and one recursive query joins them with
the merges and contracts each word's leftmost pair of lowest rank until no pair of any word is in the table. The ids of
the words are then laid out in the order of each text. Texts are never shuffled. Decoding joins the ids with the vocabulary
and puts the pieces of each text together by an ordered aggregation.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files are; a parameter of every operator here.
TOKENIZERS = os.environ.get("LAKENOTE_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pre-token pattern of the public byte-level BPE vocabularies.
PIECES = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CONTRACT = """
with recursive bpe(word, toks) using key (word) as (
  select word, list(tok order by pos) from cells group by word
  union
  select b.word, b.toks[:q.best.pos - 1] || [q.best.new] || b.toks[q.best.pos + 2:]
  from bpe b join (
    select p.word, min(struct_pack(new := m.new, pos := p.pos)) as best
    from (select word, pos, toks[pos] as l, toks[pos + 1] as r from (select word, toks, unnest(range(1, len(toks))) as pos from bpe)) p
    join merges m on m.l = p.l and m.r = p.r
    group by p.word) q on q.word = b.word
)
select word, toks from bpe order by word
"""


def byte_symbols() -> list[str]:
    """The printable symbol by which the vocabulary file writes each byte: itself, or the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """One task's DuckDB connection with the merge table of a vocabulary file."""

    def __init__(self, path: str):
        import duckdb

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], dtype=np.int32)
        new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        if (np.diff(new) <= 0).any():
            raise ValueError("the ids of this vocabulary are not in the order of its merges")
        merges = pa.table({"l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()), "new": new})
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "192MB", "temp_directory": ""})
        self.con.register("given", merges)
        self.con.execute("create table merges as select * from given")
        self.con.unregister("given")

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids): the token ids of the distinct words, one after the other."""
        raw = words.cast(pa.binary())
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        size = np.diff(ends)
        first = np.repeat(ends[:-1] - ends[0], size)
        cells = pa.table({"word": np.repeat(np.arange(len(raw), dtype=np.int32), size), "pos": np.arange(len(data), dtype=np.int32) - first.astype(np.int32), "tok": self.of_byte[data]})
        self.con.register("cells", cells)
        got = self.con.execute(CONTRACT).to_arrow_table().column("toks").combine_chunks()
        self.con.unregister("cells")
        if isinstance(got, pa.ChunkedArray):
            got = got.chunk(0) if got.num_chunks else pa.array([], pa.list_(pa.int32()))
        return np.diff(got.offsets.to_numpy()), got.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


DECODE = """
select r as row, string_agg(v.piece, '' order by t.pos) as text
from range({rows}) n(r) left join toks t on t.row = n.r left join vocab v on v.id = t.tok group by r order by r
"""


class Decoder:
    """One task's DuckDB connection with the vocabulary; bytes are written as characters of the same number."""

    def __init__(self, path: str):
        import duckdb

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {s: chr(b) for b, s in enumerate(byte_symbols())}
        known = [(i, "".join(back[c] for c in s)) for s, i in vocab.items() if all(c in back for c in s)]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "192MB", "temp_directory": ""})
        self.con.register("given", pa.table({"id": pa.array([i for i, _ in known], pa.int32()), "piece": [s for _, s in known]}))
        self.con.execute("create table vocab as select * from given")
        self.con.unregister("given")

    def decode(self, ids: pa.ListArray) -> list[str]:
        ends = ids.offsets.to_numpy()
        size = np.diff(ends)
        row = np.repeat(np.arange(len(ids), dtype=np.int64), size)
        pos = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], size)
        self.con.register("toks", pa.table({"row": row, "pos": pos, "tok": ids.flatten().cast(pa.int32())}))
        got = self.con.execute(DECODE.format(rows=len(ids))).to_arrow_table().column("text").to_pylist()
        self.con.unregister("toks")
        return [(t or "").encode("latin-1").decode("utf-8", errors="replace") for t in got]


_held: dict[str, Encoder] = {}
_open: dict[str, Decoder] = {}


def encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column(1)
            at = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            flat = pieces.flatten().dictionary_encode()
            ids, ends = np.zeros(0, np.int32), np.zeros(len(b) + 1, np.int64)
            if len(flat):
                enc = _held.get(path) or _held.setdefault(path, Encoder(path))
                lens, vals = enc.encode(flat.dictionary)
                word = flat.indices.to_numpy()
                n = lens[word]
                done = np.concatenate([[0], np.cumsum(n)])
                ids = vals[np.repeat((np.cumsum(lens) - lens)[word] - done[:-1], n) + np.arange(done[-1])]
                ends = done[at]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; the text is taken as stored.

    Null and empty texts give an empty list. Repeated rows give repeated results; a null doc_id stays; extra columns
    are ignored; an empty table gives no rows. A very long run of letters costs time square in its length, not memory.
    """
    pieces = F.coalesce(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)), F.array().cast("array<string>"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(F.col("doc_id").cast("bigint"), pieces.alias("pieces")).mapInArrow(encode_batches(f"{tokenizers}/{name}.json"), schema)


def decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dec = _open.get(path) or _open.setdefault(path, Decoder(path))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dec.decode(b.column(1)), pa.string())], names=["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the texts that the ids stand for. Null and empty lists, and ids that are not in the
    vocabulary, give no text; repeated rows give repeated results; extra columns are ignored."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    ids = F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col("doc_id").cast("bigint"), ids.alias("ids")).mapInArrow(decode_batches(f"{tokenizers}/{name}.json"), schema)
