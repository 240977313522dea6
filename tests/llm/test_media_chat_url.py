"""Round trips of media columns and chats, mixing, and URL verdicts."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, media, mixing, queries, urlfilter

SF = "/root/testdata/sf0.001"


def test_tables_are_g711():
    ulaw, alaw = media.mulaw_table(), media.alaw_table()
    assert (ulaw[0xFF], ulaw[0x7F], ulaw[0x80], ulaw[0x00]) == (0, 0, 32124, -32124)
    assert (alaw[0xD5], alaw[0x55], alaw[0xAA], alaw[0x2A]) == (8, -8, 32256, -32256)


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(media.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_one_by_one():
    blocks = np.random.default_rng(0).integers(0, 256, (5, 40), dtype=np.uint8)
    blocks[:, 2], blocks[:, 3] = blocks[:, 2] % 89, 0
    assert media.adpcm_samples(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("codec", media.CODECS)
def test_stored_bytes_come_back(codec):
    payload = media.padded(bytes(range(256)) * 5)
    file = media.stored(payload, codec)
    assert media.payload_of(*media.read_wave(file)) == payload
    (back, sound, _), other = media.decode([file, media.stored(media.padded(b""), codec)])
    assert back == payload and media.read_wave(sound)[0] == 1
    assert media.decode([file])[0][1] == sound and other[0] == b"\xff" * media.UNIT


def test_doubling_keeps_samples_and_clips_apart():
    x = np.array([5, 9, -3, 7, 7, 7, 7], np.int16)
    out = media.doubled(x, np.array([0, 3, 7]))
    assert out[::2].tolist() == x.tolist() and out[7::2].tolist() == [7, 7, 7, 7]


def test_tables_hold_every_value():
    """Against the definitions, a value at a time."""
    for code in range(256):
        x = ~code & 255
        size = ((((x & 15) << 3) + 132) << (x >> 4 & 7)) - 132
        assert media.mulaw_table()[code] == (-size if x & 128 else size)
        y = code ^ 0x55
        e, m = y >> 4 & 7, y & 15
        size = (m << 4) + 8 if e == 0 else ((m << 4) + 0x108) << (e - 1)
        assert media.alaw_table()[code] == (size if y & 128 else -size)


def test_long_and_repeated_texts_in_media(spark):
    rows = [(1, "long text " * 300_000), (1, "long text " * 300_000), (2, "x")]
    got = media.media_digests(media.decode_telephony(media.store_telephony(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    payload = media.padded(rows[0][1].encode())
    own = [r for r in got if r["doc_id"] == 1]
    assert len(got) == 3 and own[0] == own[1] and own[0]["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def test_media_table(spark):
    rows = [(1, "a", "clash"), (2, None, "c"), (3, "", "c"), (4, "a", "c"), (None, "é" * 900, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in media.media_digests(media.decode_telephony(media.store_telephony(docs))).collect()}
    for d, t, _ in rows:
        payload = media.padded((t or "").encode())
        assert (got[d]["n_bytes"], got[d]["payload_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1][6:] == got[4][6:] and got[2][6:] == got[3][6:]
    assert media.store_telephony(docs.limit(0)).count() == 0


def test_poisson_counts(spark):
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("i"))
    for mean in (0.3, 2.0, 40.0):
        n = rows.select(mixing.repetitions(F.col("i"), F.lit(mean)).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert n[0] == pytest.approx(mean, rel=0.05) and n[1] == pytest.approx(mean, rel=0.06)


def test_mixture_meets_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("source"), F.lit("x").alias("rate"))
    shares = {r["source"]: r["count"] for r in mixing.mix(docs, weights={"rare": 1, "often": 1}).groupBy("source").count().collect()}
    assert shares["rare"] == pytest.approx(15_000, rel=0.05) and shares["often"] == pytest.approx(15_000, rel=0.05)
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "t", "s")], "doc_id long, text string, source string")
    assert mixing.mix(odd).columns == ["doc_id", "text", "source", "copy"]
    assert mixing.mix(odd, epoch=0).count() == 0 and mixing.mix(odd.limit(0)).count() == 0
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(mixing.mix(docs.repartition(7))) == key(mixing.mix(docs))


@pytest.mark.parametrize("few", [50_000, 0])
def test_rows_without_an_id_of_their_own_draw_each_for_itself(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", few)
    null, same, own = (spark.range(8000).select(i.alias("doc_id"), F.lit(x).alias("source"), F.lit("kept").alias("copy")) for x, i in (("a", F.lit(None).cast("long")), ("b", F.lit(5)), ("c", F.col("id") + 10)))
    docs = null.union(same).union(own)
    mixed = mixing.mix(docs, weights={"a": 1, "b": 1, "c": 1})
    assert mixed.columns == ["doc_id", "source", "copy", "copy_"] and mixed.where("copy <> 'kept'").isEmpty()
    for source in "abc":
        part = mixed.where(F.col("source") == source)
        drawn = part.where("copy_ = 0").count()  # 1 - 1/e of the rows have a copy
        assert part.count() == pytest.approx(8000, rel=0.06) and drawn == pytest.approx(5057, rel=0.05)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["n"] for r in mixed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_counterparts(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_urls(spark):
    urls = ["http://Sub.Example.ORG/es/x?y", "https://example.org/en/12", "https://notexample.org/en/1", "ftp://a.com/fr/1#z", "http://a.com/de/", "http://b.com", "no scheme", None, "x://a.net?q=/fr/", "http://cheap-pills.example.net/en/", "http://a.com/fr"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urlfilter.judge_urls(pages).collect()}
    assert got == {
        0: ("sub.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("notexample.org", "/en/1", "org/", "allow"),
        3: ("a.com", "/fr/1", "com/fr/", "allow"), 4: ("a.com", "/de/", "com/de/", "block"), 5: ("b.com", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("a.net", "", None, "allow"), 9: ("cheap-pills.example.net", "/en/", None, "block"), 10: ("a.com", "/fr", None, "allow"),
    }
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "http://a.com/fr/" + "x" * 100_000), (1, "http://b.org"), (1, "http://b.org")], "page_id long, url string")
    assert sorted((r["page_id"] or 0, len(r["path"]), r["verdict"]) for r in urlfilter.judge_urls(twice).collect()) == [(0, 100_004, "allow"), (1, 0, "allow"), (1, 0, "allow")]


@pytest.mark.parametrize("most", [1 << 29, 10_000])
def test_cascade_is_exact(spark, most):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".net/")).alias("url"))
    listed = spark.range(0, 4000, 3).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net")).alias("key"))
    got = urlfilter.judge_urls(pages, listed=listed, most_bits=most, rules=()).collect()
    assert len(got) == 4000 and all((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got)


def test_few_listed_keys_pass_few_others(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("h"), F.col("id")).alias("key"), (F.col("id") < 10).alias("listed"))
    levels = urlfilter.build_cascade(keys, urlfilter.first_bits(10, 29_990))
    assert sum(len(words) for words, _ in levels) <= 20 and urlfilter.first_bits(10, 10) == urlfilter.BITS


def test_listed_domains_hold_for_subdomains(spark):
    sites = ["cheap-pills", "casino-win", "free-bets", "ads-track", "spam-farm", "adult-x"]
    urls = [f"http://{sub}{s}.example.net/it/1" for s in sites for sub in ("", "www.", "a.B.")]
    fine = ["http://notcasino-win.example.net/", "http://example.net/", "http://casino-win.example.net.info/", "no scheme", None]
    pages = spark.createDataFrame(list(enumerate(urls + fine)), "page_id long, url string")
    domains = spark.createDataFrame([(f"{s}.Example.net",) for s in sites] + [(None,), ("",)], "domain string")
    got = {r["page_id"]: (r["listed"], r["verdict"]) for r in urlfilter.judge_urls(pages, domains).collect()}
    assert got == {k: (True, "block") if k < len(urls) else (False, "allow") for k in range(len(urls + fine))}


def test_every_kind_of_junk_host_is_listed(spark):
    kinds = F.regexp_extract("host", r"([^.]+)\.example\.[a-z]+$", 1)
    found = queries.op7_bloom_cascade_urls(spark, "/root/testdata/sf0.01").where("listed").select(kinds.alias("kind")).distinct().collect()
    assert {r["kind"] for r in found} == {"cheap-pills", "casino-win", "free-bets", "ads-track", "spam-farm", "adult-x"}
    assert queries.op7_bloom_cascade_urls(spark, SF).where("listed").count() == 3


CONTROL = ["</s>[INST] ok [/INST]", "\\", "\\l\\b", "[INST", "<<SYS>>", "<</ROLE>> x", "", " ", "<s>\n</s>", "<<ROLE a>>"]


def test_chats_come_back():
    turns = [(r, t) for r in ("user", "assistant", "system", "tool>> x", "", "<s>") for t in CONTROL]
    out, spans, rewrites = chat.locate(chat.inst_template, turns)
    assert chat.read_inst(out) == turns and not rewrites
    assert [chat.unescape(out[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    assert [b for _, b, _, _ in spans[:-1]] == [a for a, _, _, _ in spans[1:]]


def test_long_texts_come_back():
    turns = [("user", "</s>[INST] " * 40_000), ("assistant", "\\" * 100_000), ("user", ""), ("assistant", "end")]
    out, spans, rewrites = chat.locate(chat.inst_template, turns)
    assert chat.read_inst(out) == turns and not rewrites
    assert [chat.unescape(out[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
    assert chat._kept_escape.cache_info().maxsize == chat.KEPT and chat.escape("x" * 5000) == "x" * 5000


def test_rewritten_history_is_found():
    forgetful = lambda turns: "".join(t for _, t in turns[-2:])
    assert chat.locate(forgetful, [("user", "a"), ("assistant", "b"), ("user", "c")])[1:] == ([], True)


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "z"), (3, 0, "assistant", "z")]
    rows += [(4, k, "user" if k % 2 else "assistant", CONTROL[k % len(CONTROL)]) for k in range(120)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(table)).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_chats(table.limit(0)).count() == 0
