"""Texts whose bytes are no UTF-8 are read as their U+FFFD form and end no job (op12 has its own rule: no tokens)."""

import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.conftest import SENTENCE
from tidewater.llm import binary, bpe, quality, substring

BYTES = public_tokenizers.path("byte_bpe_50k.json")
BROKEN = [b"abc \xff\xfe def", b"\x80", b"ends in \xe6\x97", b"\xed\xa0\x80 half a pair", SENTENCE.encode() * 2 + b" \xc3(", "café".encode()]


def _both(spark):
    raw = spark.createDataFrame(list(enumerate(BROKEN)), "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    return raw, raw.withColumn("text", F.make_valid_utf8("text"))


def _same(make, spark):
    got, want = (sorted(map(str, make(d).collect())) for d in _both(spark))
    assert got == want and len(got) == len(BROKEN)


def test_quality(spark):
    _same(quality.quality, spark)
    raw, _ = _both(spark)
    quality.drop_repetitive(raw).collect()


def test_substring(spark):
    _same(substring.cut_passages, spark)


def test_bpe(spark):
    _same(lambda d: bpe.encode_decode(d, BYTES), spark)


def test_files(spark, tmp_path):
    def through(d):
        out = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        binary.write_ids(d, BYTES, out)
        return binary.read_digests(spark, out)
    _same(through, spark)


def test_valid_texts_keep_their_bytes(small):
    changed = small.where(~F.make_valid_utf8("text").eqNullSafe(F.col("text")))
    assert changed.count() == 0
