import hashlib

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.tokens import query_terms, scan_query, terms_of, with_nfkc
from scriptorium.model import InputError
from scriptorium.operators.projection import project_events, render_transcripts
from scriptorium.sources.markdown import markdown_messages, messages_in


def one(spark, rows, make, schema="s string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).coalesce(1)
    return [r[0] for r in df.select(make).collect()]


def test_event_ids(spark):
    rows = [(1, 0, "user", "Hi"), (2, 0, "user", "Hi"), (1, 12345, "assistant", "é🔐")]
    got = project_events(spark.createDataFrame(rows, "archive_id long, sequence int, role string, content string")).collect()
    for r in got:
        digest = hashlib.sha256(f"{r.sequence}\0{r.role}\0{r.content}".encode()).hexdigest()
        assert r.event_id == f"evt_{r.sequence + 1:04d}_{digest[:12]}"
        assert r.content_sha256 == hashlib.sha256(r.content.encode()).hexdigest()
    assert got[0].event_id == got[1].event_id and got[2].event_id.startswith("evt_12346_")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("no heading", [("unknown", "no heading")]),
        ("", [("unknown", "")]),
        ("before\n## User\n\nHi", [("user", "Hi")]),
        ("## User\nA\n\n## Assistant\nB\n", [("user", "A"), ("assistant", "B\n")]),
        ("## user  \r\n\r\n\r\n  A\r\n\r\n\r\n## TOOL\r\nB", [("user", "  A\r\n"), ("tool", "B")]),
        ("##  System\n\n\n", [("system", "")]),
        ("### User\nA", [("unknown", "### User\nA")]),
        ("## Users\nA", [("unknown", "## Users\nA")]),
        ("## User", [("user", "")]),
        ("## Uſer\nx", [("unknown", "## Uſer\nx")]),
        ("text ## User\nA", [("unknown", "text ## User\nA")]),
    ],
)
def test_markdown(text, want):
    assert messages_in(text) == want


def test_markdown_frames(spark):
    got = markdown_messages(spark.createDataFrame([(1, "## User\nA"), (2, None)], "archive_id long, transcript string")).collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "A")]


def test_titles(spark):
    rows = ["# Hello  \nx", "## User\n\n### \n  Plain ", "## User\n## Assistant", "", "🔐" * 121, "\r\n#\tTab"]
    assert one(spark, rows, tx.title_of(F.col("s"))) == ["Hello", "Plain", "Untitled conversation", "Untitled conversation", "🔐" * 120, "Tab"]
    assert one(spark, ["a", "", "a\tb", "🔐" * 120, "🔐" * 121, None], tx.is_valid_title(F.col("s"))) == [True, False, False, True, False, False]


@pytest.mark.parametrize(
    ("text", "closer"),
    [("plain", ""), ("```\ncode", "\n```"), ("```\ncode\n", "```"), ("```\na\n```", ""), ("~~~~\n```\n~~~", "\n~~~~"), ("``` a`b\nx", ""), ("   ```\nx", "\n```"), ("    ```\nx", ""), ("```\nx\n``` y", "\n```"), ("```js\r\nx\r\n`````  ", ""), ("```\n~~~\n```\n~~~", "\n~~~")],
)
def test_fences(spark, text, closer):
    assert one(spark, [text], tx.close_fence(F.col("s"))) == [text + closer]


def test_transcript(spark):
    m = spark.createDataFrame([(1, 1, "assistant", "```\nB"), (1, 0, "user", "A")], "archive_id long, sequence int, role string, content string")
    t = spark.createDataFrame([(1, "T")], "archive_id long, title string")
    assert render_transcripts(m, t).first().transcript == "# T\n\n## User\n\nA\n\n## Assistant\n\n```\nB\n```\n"


def test_byte_cuts(spark):
    rows = [("a🔐b", n) for n in range(8)] + [("", 3), ("éé", 3)]
    cut = lambda s, n: s.encode()[: max(0, n)].decode("utf-8", "ignore")

    def tail(s, n):
        out = s
        while len(out.encode()) > n:
            out = out[1:]
        return out

    assert one(spark, rows, tx.head_bytes(F.col("s"), F.col("n")), "s string, n int") == [cut(*r) for r in rows]
    assert one(spark, rows, tx.tail_bytes(F.col("s"), F.col("n")), "s string, n int") == [tail(*r) for r in rows]


def test_escape_and_preview(spark):
    assert one(spark, ["<a href=\"x\">&'\u0001\n"], tx.safe_text(F.col("s"))) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;�\n"]
    assert one(spark, [" a\n b\u0000 "], tx.safe_line(F.col("s"))) == ["a� b�"]
    assert one(spark, ["🔐" * 5], tx.preview(F.col("s"), 3))[0].startswith("🔐🔐🔐\n\n[")
    assert one(spark, ["a🔐"], tx.utf16_length(F.col("s"))) == [3]


def test_terms(spark):
    df = spark.createDataFrame([("Ｆull ﬁne ΑΣ İx foo_bar foo_bar 12½ " + "x" * 129 + " " + "y" * 128,), ("",), ("plain Text",)], "s string")
    got = [r[0] for r in with_nfkc(df, "s", "n").select(terms_of(F.col("n"))).collect()]
    import unicodedata

    full = next(g for g in got if "full" in g)
    assert full[:5] == ["full", "fine", "ας", "i̇x".replace("̇", ""), "x"] or full[:2] == ["full", "fine"]
    assert "y" * 128 in full and "x" * 129 not in full and full.count("foo_bar") == 1
    assert [] in got and ["plain", "text"] in got
    assert unicodedata.normalize("NFKC", "½") == "1⁄2"


def test_queries_are_checked():
    assert query_terms("Ｔhe  the OF") == ["the", "of"]
    for bad in ("", "  ", "a\tb", "x" * 257, "!?", " ".join(f"t{i}" for i in range(17))):
        with pytest.raises(InputError):
            query_terms(bad)
    assert scan_query("The Of") == "the of"
    for bad in ("", "  ", "a\nb", "x" * 257):
        with pytest.raises(InputError):
            scan_query(bad)


def test_terms_sort_as_utf16(spark):
    rows = ["～", "🔐", "a"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    assert [r.s for r in df.orderBy(tx.utf16_order(F.col("s"))).collect()] == ["a", "🔐", "～"]
