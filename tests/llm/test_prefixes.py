"""Token counts of prefixes against the library, prefix by prefix."""

import json

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm.prefixes import Counter, budget_totals, check_settings, count_tokens, fitting_chars, prefix_table, tokens_of, truncated
from marlstone.llm.registry import op11_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "  ", "a", "it's they're we've I'll I'd 're ''re x'r 've", "a  b   c\n\n\nd \n e\t\tf  ", " \n", "end  <|endoftext|>  go", "!<|endoftext|><|endoftext|>'s <|endof text|>",
    "<|endoftext|>", "'<|endoftext|>re", "déjà vu — naïve Straße ΣΊΣΥΦΟΣ", "日本語のテキスト。漢字 \U0001f600\U0001f600 é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "=" * 300 + " " * 200,
    "12345 67.89 1,000 ½ ²", "\u0085  x​﻿ \x1c\x1d \x00\x01", "\U000323b0 ࢏՘ new Ᲊ letters's", "x" * 3000, "ÃÂÃÂÃÂÃÂÃÂÃÂ", "The longest prefix within a budget! " * 20, "word    " * 30 + "\n" * 50, (" " * 40 + "é漢") * 9,
]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def by_prefix(text):
    return [library(text[:k]) for k in range(1, len(text) + 1)]


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(text):
    counter = Counter.of(PATH)
    want = by_prefix(text)
    assert counter.prefix_counts(text).tolist() == want
    assert counter.count(text) == library(text)
    for budget in {0, 1, 2, 3, len(set(want)) // 2, library(text) - 1, library(text)}:
        best = max((k for k, n in enumerate(want, 1) if n <= budget), default=0)
        assert counter.longest_prefix(text, budget) == best and counter.measure(text, budget) == (library(text), best)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\t", "'", "'s", "'re", "'l", "<|endoftext|>", "<|", "the", "ing", "ABC", "42", "é", "漢", "!!", " ", "\U000323b0"]), st.text(max_size=4)), max_size=14).map("".join))
def test_any_text(text):
    counter = Counter.of(PATH)
    want = by_prefix(text)
    assert counter.count(text) == library(text) and counter.prefix_counts(text).tolist() == want
    for budget in (3, 9):
        best = max((k for k, n in enumerate(want, 1) if n <= budget), default=0)
        assert counter.longest_prefix(text, budget) == best and counter.measure(text, budget) == (library(text), best)


def test_query_over_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = op11_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts) and any(r.over_limit for r in rows)
    for r in rows:
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), library(text), library(text) > 1024)
        assert library(text[: r.fitting_chars]) <= 1024 and (r.fitting_chars == len(text) or library(text[: r.fitting_chars + 1]) > 1024)


def test_table_answers_without_encoding(spark):
    texts = [*ODD, None, ODD[4], ODD[4]]
    docs = spark.createDataFrame([(None if k == 3 else k % 12, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    table = prefix_table(docs, PATH)
    assert table.count() == len(texts)
    cut = table.select("text", "n_tokens", fitting_chars(5).alias("fit"), tokens_of(4).alias("four"), tokens_of(0).alias("none")).collect()
    for r in cut:
        want = by_prefix(r.text or "")
        assert r.fit == max((k for k, n in enumerate(want, 1) if n <= 5), default=0)
        assert (r.n_tokens, r.four, r.none) == (library(r.text or ""), library((r.text or "")[:4]), 0)
    short = truncated(table, 5).collect()
    assert all(library(r.text) == r.n_tokens <= 5 for r in short)
    totals = {r.budget: r for r in budget_totals(table, [5, 100]).collect()}
    kept = [max((k for k, n in enumerate(by_prefix(t or ""), 1) if n <= 5), default=0) for t in texts]
    assert totals[5].n_over == sum(library(t or "") > 5 for t in texts) and totals[5].kept_chars == sum(kept)
    assert totals[5].kept_tokens == sum(library((t or "")[:k]) for t, k in zip(texts, kept))


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", 5), (1, "one two", 5), (None, None, 5)], "doc_id long, text string, n_bytes long")
    assert sorted(map(tuple, count_tokens(docs, PATH, 1).collect()), key=str) == [(1, 7, 2, True, 3), (1, 7, 2, True, 3), (None, 0, 0, False, 0)]
    assert count_tokens(docs.limit(0), PATH, 1).count() == 0 and prefix_table(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        Counter(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH) as f:
        plain = json.load(f)
    check_settings(plain)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": plain["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            check_settings(plain | change)
