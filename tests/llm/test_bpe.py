import base64
import os

import pytest

from lakenote.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
FILE = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = [
    None, "", " ", "\n\n", "Hello world", "don't we'll  I'D", "naïve café 中文字符 🙂🙃", "a" * 700, "x  \t y\r\n\r\nz   ", "<|endoftext|>", "1234567890 3.14",
    "école   nbsp em", "word " * 3000, "''s 't", "\x00\x1f control", "كتاب हिन्दी ไทย", "trailing   ",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})


@pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files")
def test_ids_equal_the_public_library_and_decode_to_the_text(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, "a b", None)], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    assert len(got) == len(TEXTS) + 2
    assert got.count((0, [])) == 2
    for i, ids in got:
        text = "a b" if i is None else TEXTS[i]
        assert ids == (reference.encode_ordinary(text) if text else [])
        assert reference.decode(ids) == (text or "")


def test_empty_table(spark):
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
