"""URL reputation and byte shards."""

import zlib

import pytest
from pyspark.sql import functions as F

from probitas.llm.common import lookup_join
from probitas.llm.sharding import shard_by_bytes, write_shards
from probitas.llm.url_reputation import ADDRESS, Reputation, Rule, domain_and_suffix, host_group, judge_urls, prior_strength, read_suffix_rules

RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/")]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[:min([s.find(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), cut(rest[len(host):], "?#")


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "http://x.net/es/a",
        "http://x.net/en/a", "http://example.com", "http://example.com?/en/", "http://notexample.com/en/", "http://m.www.example.com/en/#a",
        "http://u://v.com/en/", "http://a.org/a\nb?c", "http://É.com/x"]


def test_parts_rules_and_verdicts(spark):
    rows = [(i, u, "host", "rule") for i, u in enumerate(URLS * 2)]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = plain_parts(URLS[r.page_id % len(URLS)])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_reputation_shrinks_and_blocks_only_where_it_is_sure(spark):
    rows = [(f"http://bad{h}.spam.org/{i}", 1) for h in range(4) for i in range(30)]
    rows += [(f"http://ok{h}.fine.org/{i}", 0) for h in range(4) for i in range(30)]
    rows += [("http://new.spam.org/", None), ("http://new.fine.org/", None), ("http://new.other.info/", None)]
    df = spark.createDataFrame(rows, "url string, bad int")
    out = {r.url: r for r in judge_urls(df, [], Reputation(), outcome=F.col("bad")).collect()}
    assert out["http://bad1.spam.org/3"].verdict == "block" and out["http://ok1.fine.org/3"].verdict == "allow"
    assert out["http://new.spam.org/"].verdict == "block" and out["http://new.fine.org/"].verdict == "allow"
    assert out["http://new.other.info/"].verdict == "allow"  # nothing known of its suffix
    assert out["http://new.fine.org/"].mean < out["http://new.other.info/"].mean < out["http://new.spam.org/"].mean


HOSTS = {  # host: the host of its reputation, domain, suffix
    "": ("", "", ""), "com": ("com", "com", "com"), "a.com:8080": ("a.com", "a.com", "com"), "me:pw@b.a.com:": ("b.a.com", "a.com", "com"),
    "a.com.": ("a.com", "a.com", "com"), "co.uk": ("co.uk", "co.uk", "co.uk"), "x.y.co.uk": ("x.y.co.uk", "y.co.uk", "co.uk"),
    "10.0.0.1": ("10.0.0.1", "10.0.0.1", ADDRESS), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", ADDRESS), "1.2.3": ("1.2.3", "2.3", "3"),
    "[::1]:8080": ("[::1]", "[::1]", ADDRESS), "a.b.c.ck": ("a.b.c.ck", "b.c.ck", "c.ck"), "c.ck": ("c.ck", "c.ck", "c.ck"),
    "a.www.ck": ("a.www.ck", "www.ck", "ck"), "ck": ("ck", "ck", "ck"), "localhost": ("localhost", "localhost", "localhost"),
    "x.city.kobe.jp": ("x.city.kobe.jp", "city.kobe.jp", "kobe.jp"), "p.q.kobe.jp": ("p.q.kobe.jp", "p.q.kobe.jp", "q.kobe.jp")}


def test_domains_and_suffixes(spark, tmp_path):
    (tmp_path / "suffixes").write_text("// a comment\n\nCO.UK  rest\nuk\n*.ck\n!www.ck\njp\n*.kobe.jp\n!city.kobe.jp\n")
    rules = read_suffix_rules(spark, str(tmp_path / "suffixes"))
    assert rules == ("co.uk", "uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp")
    with pytest.raises(ValueError, match="suffix rules"):
        read_suffix_rules(spark, str(tmp_path / "suffixes"), 3)
    df = spark.createDataFrame([(h,) for h in HOSTS], "h string").withColumn("g", host_group(F.col("h")))
    out = df.select("h", "g", domain_and_suffix(F.col("g"), Reputation(long_suffixes=rules)).alias("n")).select("h", "g", "n.*").collect()
    assert {r.h: (r.g, r.domain, r.suffix) for r in out} == HOSTS


def test_ports_and_users_share_the_reputation_of_their_host(spark):
    rows = [(f"http://bad.org:{i}/x", 1) for i in range(60)] + [(f"http://10.0.0.{i}/x", 0) for i in range(60)] + [("http://u:p@bad.org./new", None)]
    out = {r.url: r for r in judge_urls(spark.createDataFrame(rows, "url string, bad int"), [], outcome=F.col("bad")).collect()}
    new = out["http://u:p@bad.org./new"]
    assert (new.host, new.verdict) == ("u:p@bad.org.", "block") and new.mean == out["http://bad.org:3/x"].mean
    assert out["http://10.0.0.7/x"].verdict == "allow"


def test_prior_strength_follows_the_spread():
    from pyspark.sql import Row
    groups = lambda xs, n: Row(k=len(xs), s0=n * len(xs), s1=sum(xs), s2=sum(x * x / n for x in xs), nn=n * n * len(xs))
    cfg = Reputation()
    assert prior_strength(groups([0, 20, 0, 20], 20), cfg) == cfg.min_strength
    assert prior_strength(groups([10, 10, 10, 10], 20), cfg) == cfg.max_strength
    assert cfg.min_strength < prior_strength(groups([4, 8, 12, 16], 20), cfg) < cfg.max_strength


def test_no_pages(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_lookup_join_with_a_hot_key_nulls_and_misses(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(3000)] + [(None, -1), ("miss", -2)], "k string, i int")
    right = left.where("k is not null and k <> 'miss'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = {(r.k, r.i): (r.n, r.m) for r in lookup_join(left, right, "k", "n").collect()}
    want = {r.k: (r.n, r.m) for r in right.collect()}
    assert len(got) == 3002 and all(v == want.get(k, (None, None)) for (k, _), v in got.items())


@pytest.mark.parametrize("n", [1, 3, 24])
def test_shards_are_contiguous_balanced_and_gapless(docs, odd_texts, n):
    texts = odd_texts * 5
    out = sorted(shard_by_bytes(docs(texts), n).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 8 for t in texts]
    assert [r.size for r in out] == sizes and [r.text_crc32 for r in out] == [zlib.crc32((t or "").encode()) for t in texts]
    total, before, slots = sum(sizes), 0, {}
    for r, s in zip(out, sizes):
        assert r.shard == min(n - 1, (2 * before + s) * n // (2 * total))
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        before += s
    assert [r.shard for r in out] == sorted(r.shard for r in out)


def test_shards_of_null_and_repeated_ids_and_of_nothing(docs):
    out = shard_by_bytes(docs(["a", "a", "bb", None], [None, None, 5, 5]), 2).collect()
    assert sorted(r.size for r in out) == [8, 9, 9, 10] and {r.shard for r in out} == {0, 1}
    for s in (0, 1):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shard_by_bytes(docs([]), 4).collect() == []


def test_written_shards_hold_all_columns(spark, docs, odd_texts, tmp_path):
    write_shards(docs(odd_texts).drop("shard"), 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=lambda r: r[0]) == list(enumerate(odd_texts))
    assert {"lang", "source", "kept", "slot", "shard"} <= set(back.columns)
