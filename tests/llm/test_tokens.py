"""Token files: whole-text encoding, order, offsets, edge cases."""

import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyarrow import orc
from tokenizers import Tokenizer

from marlstone.llm.tokens import Encoder, _Ids, read_token_files, token_index, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    "Hello, world! It's 2024...",
    "ÉTÉ déjà Straße naïve été ΣΊΣΥΦΟΣ",
    "a b c\td\ne\x0bf",
    "<|endoftext|> <|EndOfText|> x<|startoftext|>y",
    "we'll we've I'M don't''s",
    "ÀÉÎõü ñandú e\u0301te\u0301 ŀ ŉ ǆ ª º ß ẞ İstanbul ıiİI ʼn ÿ ſ µ mªºa",
    "!!! ??? .,.;: --- a.b,c 12,345.67",
    "日本語のテキスト。漢字",
    "x" * 5000,
    "## $$$ a*** b&&& \u0001 �",
    "end.) (start. quote.' Word.) W.O.R.D.",
]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_chunks_give_the_ids_of_whole_texts(spark):
    rows = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + rows
    encoder = Encoder(PATH)
    for _ in range(2):
        sizes, values = encoder(pa.array(texts, pa.string()), 2)
        got = np.split(values, np.cumsum(sizes)[:-1])
        assert [x.tolist() for x in got] == [[*w, 2] for w in whole(texts)]
    for kind in (pa.string(), pa.large_string()):
        sizes, values = encoder(pa.array(["before", None, "<|X|> Y", "x Z", "padding"], kind).slice(1, 3), 2)
        assert [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])] == [[*w, 2] for w in whole(["", "<|X|> Y", "x Z"])]
    assert [len(x) for x in encoder(pa.array([], pa.string()), 2)] == [0, 0]


def test_tokenizers_that_keep_case_are_refused(tmp_path):
    from tokenizers import normalizers, pre_tokenizers

    t = Tokenizer.from_file(PATH)
    t.normalizer = normalizers.NFC()
    t.save(str(tmp_path / "kept.json"))
    with pytest.raises(ValueError):
        Encoder(str(tmp_path / "kept.json"))
    t = Tokenizer.from_file(PATH)
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    t.save(str(tmp_path / "spaces.json"))
    with pytest.raises(ValueError):
        Encoder(str(tmp_path / "spaces.json"))


@pytest.mark.parametrize("ids", [list(range(len(ODD))), [3] * len(ODD)])
def test_index_from_files(spark, tmp_path, ids):
    rows = [(i, t, "x") for i, t in zip(ids, ODD)] + [(None, None, "y"), (99, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    write_token_files(docs, str(tmp_path / "t"), PATH, 2)
    got = token_index(read_token_files(spark, str(tmp_path / "t"))).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((i is not None, i or 0, len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for (i, t, _), w in zip(rows, whole([t or "" for _, t, _ in rows])))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_token_files(docs, str(tmp_path / "t"), PATH, 2)
    assert token_index(read_token_files(spark, str(tmp_path / "t"))).count() == 0


def test_stripes_indexes_bloom_filters_and_pruning(spark, tmp_path):
    """What the footers hold, and that a filter on the id reads few of the rows."""
    docs = spark.range(60_000).selectExpr("id * 2 AS doc_id", "concat('word', id % 977, ' and ', sha2(cast(id AS string), 256), repeat(' more words of it', 12)) AS text")
    path = str(tmp_path / "t")
    write_token_files(docs.coalesce(1), path, PATH, 2, stripe_bytes=1 << 20, shards=2)
    files = sorted(f for f in os.listdir(path) if f.endswith(".orc"))
    assert len(files) == 2
    parts = [orc.ORCFile(os.path.join(path, f)) for f in files]
    assert sum(f.nrows for f in parts) == 60_000
    assert all(f.nstripes > 1 and f.row_index_stride == 1000 for f in parts)
    #: shards are ranges of ids
    ends = [f.read(columns=["doc_id"]).column("doc_id").to_pylist() for f in parts]
    assert ends[0] == sorted(ends[0]) and ends[1] == sorted(ends[1]) and ends[0][-1] < ends[1][0]
    java = spark.sparkContext._jvm
    reader = java.org.apache.orc.OrcFile.createReader(java.org.apache.hadoop.fs.Path(os.path.join(path, files[0])), java.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    kinds = [str(s.getKind()) for s in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()] if hasattr(reader.rows(), "readStripeFooter") else []
    assert not kinds or {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= set(kinds)

    found = read_token_files(spark, path).where("doc_id = 54322").select("doc_id", "n_tokens")
    assert "EqualTo(doc_id,54322)" in found._jdf.queryExecution().toString()
    assert [r.doc_id for r in found.collect()] == [54322]
    #: rows that the scan hands on, by its own metric
    scan = found._jdf.queryExecution().executedPlan()
    leaf = scan.collectLeaves().apply(0)
    read = leaf.metrics().apply("numOutputRows").value()
    assert 0 < read <= 2000
    assert read_token_files(spark, path).where("doc_id = 54323").count() == 0
    #: stripes are read in parallel
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        assert read_token_files(spark, path).rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pieces_cover_a_batch(monkeypatch):
    import pyarrow as pa

    from marlstone.llm import tokens

    monkeypatch.setattr(tokens, "PIECE_BYTES", 10)
    for texts in ([], [None], ["", None, "x" * 35, "é" * 3, ""] + ["abc"] * 9):
        batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
        pieces = list(tokens._pieces(batch, 0))
        assert [t for p in pieces for t in p.column(0).to_pylist()] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()[:-1]) < 20 for p in pieces)
    assert len(pieces) > 3


def test_remembered_words_are_bounded(spark, tmp_path):
    """A worker holds two generations of words, and how many it remembers does not change the files."""
    ids = _Ids(None)
    ids._encoded, ids.remembered = lambda chunk: [7], 100
    for k in range(2000):
        ids.forget()
        assert ids[b"w%d" % (k if k % 2 else 0)] == (7).to_bytes(4, "little")
        assert len(ids) + len(ids.before) <= 2 * 101
    docs = spark.createDataFrame([(k, f"word{k} {ODD[k % len(ODD)]}") for k in range(60)], "doc_id long, text string")
    found = []
    for many in (1, 350_000):
        write_token_files(docs, f"{tmp_path}/{many}", PATH, 2, shards=3, remembered=many)
        found.append(sorted(map(tuple, token_index(read_token_files(spark, f"{tmp_path}/{many}")).collect())))
    assert found[0] == found[1] and len(found[0]) == 60
