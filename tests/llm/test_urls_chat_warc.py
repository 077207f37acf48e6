"""URL filter, chat formatting and fixity audit."""

import gzip
import hashlib
from collections import Counter

import pytest
from helpers import clashing
from hypothesis import given, strategies as st
from pyspark.sql import Row, functions as F

from phonolith.llm import chat, queries, sql, urls, warc


@pytest.mark.parametrize("name", ["op1_warc_fixity", "op5_url_filter", "op9_chat"])
def test_sql(name, same):
    same(queries.queries()[name], sql.ORACLES[name])


CASES = [
    ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/"), ("https://x.net", "x.net", "", None), ("https://x.net/", "x.net", "/", "net/"),
    ("http://notnet/a", "notnet", "/a", None), ("http://example.com/de/", "example.com", "/de/", "example.com/de/"), ("http://myexample.com/de/", "myexample.com", "/de/", None),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b?c://d", "b", "", None), ("x://", "", "", None), ("http://É.ORG/fr/#", "É.org", "/fr/", "org/fr/"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(None, "http://x.org"), (0, CASES[0][0])], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = urls.judge(clashing(pages), none).collect()
    assert len(got) == len(CASES) + 2
    by = {r["page_id"]: r for r in got}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"], by[i]["verdict"]) == (host, path, rule, urls.RULES.get(rule, "allow"))
    assert urls.judge(pages.filter("false"), none).collect() == []


def test_reputation(spark):
    """A host with many bad pages is blocked, its neighbour isn't; an unseen host takes its domain's rate."""
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site.com/{i}") for i in range(400)] + [(900, "http://new.worse.org/x"), (901, "http://other.dev/")]
    pages += [(500 + i, f"http://h{i % 5}.worse.org/{i}") for i in range(200)]
    pages += [(2000 + i, f"http://fine{i % 7}.info/{i}") for i in range(400)]
    bad = [(2000 + i, 0) for i in range(400)] + [(i, i % 2) for i in range(300)] + [(500 + i, 1) for i in range(200)] + [(None, 1), (1, None), (77777, 1)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert got[399] == "block" and got[398] == "allow" and got[900] == "block" and got[901] == "allow"


@given(st.text(alphabet="<|\\im_start>ax\n", max_size=30))
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    role, back = chat.parse_turn(f"{chat.START}user\n{chat.escape(text)}{chat.END}")
    assert (role, back) == ("user", text)


@given(st.text(alphabet="<|\\nim_\n\r", max_size=20), st.text(alphabet="<|\\\na", max_size=20))
def test_roles_read_back(role, text):
    assert chat.parse_turn(f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}") == (role, text)


def test_suffixes(spark):
    """a.co.uk and b.co.uk are domains of their own."""
    m, host = urls.Model(), F.col("host")
    hosts = ["x.a.co.uk", "a.co.uk", "co.uk", "www.site.com", "com", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select(urls.domain(host, m), urls.suffix(host, m)).collect()
    assert list(map(tuple, rows)) == [("a.co.uk", "co.uk"), ("a.co.uk", "co.uk"), ("co.uk", "co.uk"), ("site.com", "com"), ("com", "com"), ("", "")]
    pages = [(i, f"http://h.bad.co.uk/{i}") for i in range(60)] + [(100 + i, f"http://h.good.co.uk/{i}") for i in range(60)] + [(900, "http://new.bad.co.uk/"), (901, "http://new.good.co.uk/"), (902, "http://x/" + "y" * 200000)]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert (got[900], got[901]) == ("block", "allow")


def test_warc_files(spark, tmp_path):
    """Records written by hand, plain and packed, read back at the offsets that the audit compares."""
    docs = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i * 7)) for i in range(40)] + [(41, "http://long", "z" * 3_000_000)], "page_id long, url string, html string")
    want = warc.write_records(docs)
    raw = [r[0].encode() for r in docs.orderBy("page_id").select(warc.record(F.col("url"), F.col("html"))).collect()]
    (tmp_path / "part-00000000.warc").write_bytes(b"".join(raw))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    read = warc.read_records(spark, str(tmp_path)).withColumn("page_id", F.lit(0).cast("long"))
    got = read.filter("file = 'part-00000000.warc'")
    assert Counter(r["status"] for r in warc.audit(want, got).collect()) == {"ok": 41}
    packed = read.filter("file = 'packed.warc.gz'").collect()
    assert [bytes(r["record"]) for r in sorted(packed, key=lambda r: r["offset"])] == raw


def test_repeated_records_stay_apart(spark):
    """One page without bound, and pages without an id: offsets are gapless in each file."""
    rows = [(5, "u", "same")] * 300 + [(None, f"v{i}", "x") for i in range(40)] + [(6, "u", "other")]
    got = warc.write_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append((r["offset"], r["length"]))
    assert len(got) == 341 and len(files) > 20
    for own in files.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


def test_many_contents_of_one_page(spark, tmp_path):
    """A page with a third of all records, all different: its file is split, and both engines agree on every place."""
    import duckdb

    rows = [(5, "u", f"<{i}>") for i in range(400)] + [(5, "u", "<7>")] * 30 + [(i, "v", f"<p>{i}") for i in range(600)] + [(None, "w", f"<{i}>") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(sql._warc().replace("from pages)", f"from '{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert Counter(map(tuple, queries.op1_warc_fixity(spark, str(tmp_path)).select("page_id", "file", "offset", "length", "sha256", "status").collect())) == Counter(want)
    shape = warc.Shape(pages_per_file=16, most=64)
    got = warc.write_records(spark.read.parquet(str(tmp_path / "pages.parquet")), shape).collect()
    places = duckdb.sql(sql._warc(shape).replace("from pages)", f"from '{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert Counter((r["page_id"], r["file"], r["offset"], r["length"], r["sha256"]) for r in got) == Counter(r[:5] for r in places)
    distinct = Counter(r["file"] for r in {*got})
    assert max(distinct.values()) < 128 and sum(f.startswith("part-00000000-") for f in distinct) == 7


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_chat_awkward(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 0, "assistant", "x" * 100000), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "ro\nle<|", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(clashing(df).withColumn("parts", chat.text_part(F.col("text"))))
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 1 and got[1]["loss_sha256"] == digest(["b"])
    assert got[1]["turns_sha256"] == digest(["\nfirst\n", "user\nhi <|im_end|>\n", "assistant\n\n", "assistant\nb\n"])
    assert got[None]["loss_chars"] == 100000 and got[2]["n_turns"] == 2 and got[3]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.filter("false").withColumn("parts", chat.text_part(F.col("text"))))).collect() == []


def test_parts(spark):
    part = lambda **k: Row(**({"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k))
    parts = [part(type="text", text="see "), part(type="image", ref="a.png", width=56, height=29), part(type="audio", ref="b.wav", seconds=1.5), part(type="document", ref="c.pdf", pages=2), part(type="text", text="<|image|>")]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df).first()
    assert r["formatted"] == "<|im_start|>user\nsee <|image|><|audio|><|document|><\\|image|><|im_end|>\n"
    assert [(a["kind"], a["ref"], r["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>"), a["tokens"]) for a in r["attachments"]] == [("image", "a.png", True, 4), ("audio", "b.wav", True, 38), ("document", "c.pdf", True, 1200)]
    assert r["tokens"] == 1242
    with pytest.raises(Exception, match="a part of type 'video'"):
        chat.format_turns(df.withColumn("parts", F.transform("parts", lambda p: p.withField("type", F.lit("video"))))).collect()


def pages(spark, n):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.lit("z"), (F.col("id") % 50).cast("int")).alias("html"))


def test_fixity(spark):
    shape = warc.Shape(range_bytes=2048, fanout=4, pages_per_file=40)
    primary = warc.write_records(pages(spark, 700), shape)
    assert Counter(r["status"] for r in warc.audit(clashing(primary), primary, shape).collect()) == {"ok": 700}
    hurt = primary.filter("page_id <> 123").withColumn("sha256", F.when(F.col("page_id").isin(5, 699), F.lit("rot")).otherwise(F.col("sha256")))
    extra = primary.filter("page_id = 9").withColumn("file", F.lit("new.warc"))
    rows = warc.audit(primary, hurt.unionByName(extra), shape).collect()
    assert {(r["page_id"], r["status"]) for r in rows if r["status"] != "ok"} == {(123, "missing"), (5, "corrupt"), (699, "corrupt"), (9, "extra")} and len(rows) == 701


def test_fixity_awkward(spark):
    odd = spark.createDataFrame([(None, None, None), (1, "u", None), (1, "u", None), (1, "u", "é"), (2, None, "")], "page_id long, url string, html string")
    primary = warc.write_records(clashing(odd))
    assert Counter(r["status"] for r in warc.audit(primary, primary).collect()) == {"ok": 5}
    assert Counter(r["status"] for r in warc.audit(primary, primary.filter("false")).collect()) == {"missing": 5}
    assert Counter(r["status"] for r in warc.audit(primary.filter("false"), primary).collect()) == {"extra": 5}
    assert warc.audit(primary.filter("false"), primary.filter("false")).collect() == []
    again = primary.filter("page_id = 2")
    assert Counter(r["status"] for r in warc.audit(primary.union(again), primary).collect()) == {"ok": 5, "missing": 1}


def test_descent_opens_only_what_differs(spark):
    """Roots of equal replicas match; a changed record changes its file's root and the replica's only."""
    from phonolith.llm.common import Tables

    shape, tables = warc.Shape(range_bytes=2048, fanout=4, pages_per_file=40), Tables(spark, "test")
    a = warc.write_records(pages(spark, 300), shape)
    b = a.withColumn("sha256", F.when(F.col("page_id") == 7, F.lit("rot")).otherwise(F.col("sha256")))
    x, y = warc.tree(a, shape, tables)[-1], warc.tree(b, shape, tables)[-1]
    assert [r["file"] for r in warc._differs(x, y, ["file", "node"]).collect()] == ["part-00000000.warc"]
