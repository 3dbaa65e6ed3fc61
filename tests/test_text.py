import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "tokens"), [("", 1), ("abcd", 2), ("é", 1), ("a" * 400, 101)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, text, T.token_estimate) == tokens


@pytest.mark.parametrize("text", ["", "x" * 200, "x" * 201, "é" * 101, "x" * 199 + "é", "x" * 198 + "€uro", "x" * 197 + "😀z", "𝒜" * 90])
def test_preview_cuts_whole_characters(spark, text):
    raw = text.encode()
    want = text if len(raw) <= 200 else raw[:200].decode(errors="ignore") + "..."
    assert one(spark, text, T.preview) == want


@pytest.mark.parametrize(("text", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("a\r\nb", 2)])
def test_line_count(spark, text, lines):
    assert one(spark, text, T.line_count) == lines
    assert one(spark, text, lambda c: F.size(T.lines_of(c))) == lines


@pytest.mark.parametrize(("text", "slug"), [("Hello World_2!", "hello-world-2"), ("!!!", "untitled"), ("--A  b--", "a-b"), ("Ünïcode", "n-code")])
def test_slugify(spark, text, slug):
    assert one(spark, text, T.slugify) == slug


@pytest.mark.parametrize(("slug", "ok"), [("", False), ("../x", False), ("a//b", False), ("a/b", True), ("/a", False), ("a\\b", False), (None, False)])
def test_slug_validation(spark, slug, ok):
    assert one(spark, slug, T.is_valid_slug) is ok


def test_wikilinks(spark):
    text = "see [[a/b]] [[ c ]] [[a/b]] [[]] [[x [[y]] z [[open"
    assert one(spark, text, T.wikilinks) == ["a/b", "c", "x [[y"]


def test_identifier_parts(spark):
    assert one(spark, "fooBarBaz2x", T.identifier_parts) == ["foo", "Bar", "Baz", "2", "x"]
    assert one(spark, "HTTPServer", T.identifier_parts) == ["HTTPServer"]


@pytest.mark.parametrize(("limit", "size"), [(None, 20), (0, 20), (-3, 20), (math.nan, 20), (0.4, 1), (2.5, 3)])
def test_page_limits(limit, size):
    assert T.resolve_page(limit)[0] == size
    assert T.resolve_page(limit, -1)[1] == 0
    assert T.resolve_page(limit, 3.9)[1] == 3


@given(st.one_of(st.none(), st.floats()), st.one_of(st.none(), st.floats()))
def test_page_is_always_usable(limit, offset):
    size, skip = T.resolve_page(limit, offset)
    assert size >= 1 and skip >= 0
