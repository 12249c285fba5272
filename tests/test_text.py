"""Transcripts, sentences, claims, folds, full text and streams: expectations and plain versions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import claims, editor, fulltext
from lodestone.sources import transcripts
from lodestone.sources.store import SnapshotStore, UpsertLog
from lodestone.streaming import ingest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def told(spark, parser, payload):
    return [(s["start"], s["duration"], s["text"], s["speaker"]) for s in one(spark, parser(F.lit(payload)))]


def test_transcripts(spark):
    xml = '<t><text start="1.5" dur="2">a &amp;lt; <b>b</b></text><text start="x" dur="1">c</text><text start="3" dur="1"> </text></t>'
    assert told(spark, transcripts.from_xml, xml) == [(1.5, 2.0, "a &lt; b", None)]
    json = ")]}'\n" + '{"events": [{"tStartMs": 1200, "segs": [{"utf8": "a "}, {"utf8": "b"}, {}]}, {"tStartMs": 5}, {"segs": [{"utf8": "\\n"}]}]}'
    assert told(spark, transcripts.from_json, json) == [(1.2, 0.0, "a b", None)]
    vtt = "WEBVTT\r\nKind: captions\r\n\r\n1\r\n00:01.5 --> 00:00:03.000 align:start\r\n<v Ann B>Hello <i>you</i></v>\r\nthere\r\n\r\n5.0 --> 6.0\r\nno clock\r\n\r\n01:00:02.000 --> 01:00:01.000\r\nDefinition: x"
    got = told(spark, transcripts.from_vtt, vtt)
    assert [(s, d) for s, d, _, _ in got] == [(1.5, 1.5), (3602.0, 0.0)] and got[0][3] == "Ann B" and got[1][2:] == ("Definition: x", None)
    ttml = '<p begin="00:00:01.250" end="00:02">a<br/>b</p><p begin="3s" dur="1.5s">c</p><p begin="5s" end="4s">d</p><p>e</p>'
    assert told(spark, transcripts.from_ttml, ttml) == [(1.25, 0.75, "ab", None), (3.0, 1.5, "c", None), (5.0, 0.0, "d", None)]
    for parser in (transcripts.from_xml, transcripts.from_json, transcripts.from_vtt, transcripts.from_ttml, transcripts.parsed):
        assert [told(spark, parser, x) for x in ("", "{", "plain")] == [[], [], []]
        assert one(spark, parser(F.lit(None).cast("string"))) == []
    assert told(spark, transcripts.parsed, vtt) == got
    assert one(spark, transcripts.caption_tracks(F.lit('<track id="0" lang_code="en" name="a&amp;b"/>'))) == [{"id": "0", "lang_code": "en", "name": "a&b"}]


def plain_sentences(x):
    """Letter by letter."""
    x, out, now = " ".join(x.split()), [], ""
    for i, ch in enumerate(x):
        now += ch
        over = ch in ".!?" or ch in "\"')]}" and i and x[i - 1] in ".!?"
        word = "".join(c for c in now.split()[-1].lower() if c.isascii() and c.isalnum()) if now.strip() else ""
        if over and word not in text.ABBREVIATIONS and x[i + 1 : i + 2] in ("", " "):
            out, now = [*out, now.strip()], ""
    return out + [now.strip()] * bool(now.strip())


def test_sentences_against_plain(spark):
    rng = random.Random(5)
    bits = ["Dr.", "e.g.", "1.5", "end.", 'so."', "what?!", "(yes.)", "...", ".", "a", " ", "  ", "vs", "etc.)", "é!", '"', "x.'\"" ]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randrange(0, 12)))) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", text.sentences(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["s"] == plain_sentences(rows[r["i"]][1])


def test_sentence_shape(spark):
    c = lambda s: one(spark, text.complete(F.lit(s)))
    assert [c(s) for s in ("All is well.", "all is well.", "All is well and", '"All is well."', '"All is well.', "All (is well", "")] == [True, False, False, True, True, False, False]
    assert [one(spark, text.dangling(F.lit(s))) for s in ("this is.", "so, but", "done.", "wait…", "x;", "band")] == [True, True, False, True, True, False]
    assert [one(spark, text.starts_with_connector(F.lit(s))) for s in ("(And so", "Android", "because")] == [True, False, True]
    assert one(spark, text.heuristic_confidence(F.lit("Take 5 mg of it."))) == pytest.approx(0.4 + 0.15 + 0.1 + 0.1 + 16 / 200)
    assert one(spark, text.key(F.lit("  It’s “A”, b.  "))) == "its a b"


def packed(sentences: list[str], most: int) -> list[str]:
    """Sentences joined up to the token budget; one over the budget starts a chunk of its own and is split at words."""
    size = lambda s: -(-len(s) // 4)
    out, now, total = [], [], 0
    for s in sentences:
        over = size(s) > most
        for i, unit in enumerate(s.split() if over else [s]):
            if now and ((over and not i) or total + 1 + size(unit) > most):
                out.append(" ".join(now))
                now, total = [], 0
            total += size(unit) + bool(now)
            now.append(unit)
    return out + ([" ".join(now)] if now else [])


def test_packed():
    assert packed(["aaaa bbbb", "cccc"], 5) == ["aaaa bbbb cccc"]
    assert packed(["aaaa bbbb", "cccc"], 4) == ["aaaa bbbb", "cccc"]
    assert packed(["x.", "aaaa bbbb cccc dddd", "e."], 3) == ["x.", "aaaa bbbb", "cccc dddd", "e."]
    assert packed([], 3) == []


def test_same_meaning():
    base = "regular strength training improves bone density among older adults"
    assert editor.same_meaning(base, base + " overall")
    assert not editor.same_meaning(base, base.replace("improves", "never improves"))
    assert not editor.same_meaning("it doesn't help " + base, "it does help " + base)
    assert not editor.same_meaning(base + " 10", base + " 12")
    assert not editor.same_meaning("women gain", "men gain")


def plain_fold(rows):
    rows = sorted(rows, key=lambda r: (-r[3], r[2], r[1]))
    first = []
    for r in rows:
        def repeats(k, r=r):
            if editor.key_of(k[1]) == editor.key_of(r[1]):
                return True
            a, b = set(k[4]), set(r[4])
            near = a and b and len(a & b) / min(len(a), len(b)) >= 0.8
            x, y = (editor.words_of(t, text.STOPWORDS) for t in (k[1], r[1]))
            return near and x and y and len(x & y) / len(x | y) >= 0.4
        if not any(map(repeats, first)):
            first.append(r)
    kept = []
    for r in first:
        if not any(editor.same_meaning(r[1], k[1]) for k in kept):
            kept.append(r)
    return sorted(r[0] for r in kept)


def test_folds_against_plain(spark):
    rng = random.Random(6)
    words = "not more red blue green 10 12 fish bird tree the doesn't can't".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9))), float(rng.randrange(50)), rng.randrange(1000) / 1000, rng.sample("abcdef", rng.randrange(0, 4))) for i in range(250)]
    df = spark.createDataFrame([("v", *r) for r in rows], "video string, id int, text string, start double, score double, excerpt_ids array<string>")
    got = sorted(r["id"] for r in editor.deduped(df).collect())
    assert got == plain_fold(rows) and len(got) < 250
    none = editor.keep_first(pd.DataFrame([{"video": "v", "id": 1, "text": "", "start": None, "score": 0.0, "excerpt_ids": None}]))
    assert len(none) == 1


def test_scores(spark):
    rows = spark.createDataFrame([("v", "a", "Subscribe and use code ABC10 for a special offer", 0.9, ["e"], "health"), ("v", "b", "It is good", None, [], None)], "video string, id string, text string, confidence double, excerpt_ids array<string>, domain string")
    got = {r["id"]: r["s"] for r in rows.select("id", editor.score_v2(rows).alias("s")).collect()}
    #           confidence   length          one action      evidence    domain  boilerplate, short (48 letters)
    assert got["a"] == pytest.approx(max(0.0, 0.18 + 0.1 * 48 / 220 + 0.25 * 0.25 + 0.15 * 0 + 0.15 / 6 + 0.15 - 0.55 - 0.5))
    assert got["b"] == 0
    assert one(spark, editor.specificity(F.lit("We saw Paris in 2020"))) == 1.0


def test_time_chunks(spark):
    rows = spark.createDataFrame([("v", i, s) for i, s in enumerate([0.0, 50.0, 130.0, 200.0, 260.0])] + [("w", 9, None)], "video string, id int, start double")
    chunks = lambda **k: {r["id"]: r["chunk"] for r in editor.time_chunks(rows, 2, **k).collect()}
    assert chunks() == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 9: 0}
    assert chunks(most=2) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 9: 0}


def test_stem_and_search(spark):
    known = "caresses caress ponies poni agreed agre plastered plaster hopping hop falling fall filing file happy happi sky sky relational relat conditional condit triplicate triplic adjustable adjust adoption adopt probate probat cease ceas controlling control rate rate feed feed bled bled"
    pairs = known.split()
    assert [fulltext.stem(w) for w in pairs[::2]] == pairs[1::2]
    nodes = spark.createDataFrame([("a", "Claim", "Running dogs", None), ("b", "Excerpt", "x", "The dog runs"), ("c", "Task", "dog run", None)], "id string, type string, label string, content string")
    postings = fulltext.index(nodes)
    ids = lambda q, **k: sorted(r["id"] for r in fulltext.search(postings, q, **k).collect())
    assert ids("dogs run") == ["a", "b"] and ids("dog", types=("Claim",)) == ["a"] and ids("dog cat") == [] and ids(' "" ') == []


def graph_of(spark):
    n = "id string, type string, label string, content string, metadata string"
    nodes = [
        ("r1", "Resource", "Talk", None, '{"url":"http://v","channelName":"Ch"}'), ("r2", "Resource", "Empty", None, "{}"),
        ("e1", "Excerpt", "", "said  this", '{"start":65,"speaker":"Ann"}'), ("e2", "Excerpt", "", "later", '{"start":90}'),
        ("c1", "Claim", "one", "Claim one", '{"resourceId":"r1","domain":"d","confidence":0.5,"echoOverlapRatio":0.25}'),
        ("c2", "Claim", "two", None, '{"resourceId":"r1","state":"draft"}'), ("c3", "Claim", "lost", None, '{"resourceId":"r9"}'),
        ("x1", "Reference", "", None, '{"url":"http://x"}'),
    ]
    edges = [("c1", "claimDerivedFrom", "e2"), ("c1", "claimDerivedFrom", "e1"), ("c1", "claimMentionsReference", "x1"), ("c2", "claimMentionsReference", "x1")]
    return spark.createDataFrame(nodes, n), spark.createDataFrame(edges, "subject string, predicate string, object string")


def test_claims(spark):
    nodes, edges = graph_of(spark)
    out = {r["resource_id"]: r["markdown"] for r in claims.dossiers(nodes, edges).collect()}
    assert out["r1"] == "\n".join([
        "# Dossier: Talk", "", "- Channel: Ch", "- Video: http://v", "", "## Claims", "", "1. [1:05](http://v?t=65) Claim one", "   - Excerpt: said this", "   - Speaker: Ann",
        "   - **Domain:** d", "   - Meta: confidence=0.50, echo=25%", "   - References: http://x", "", "## References", "", "- http://x", "",
    ])
    assert "_No claims extracted._" in out["r2"] and "_No references extracted._" in out["r2"]
    assert [r["id"] for r in claims.review_queue(nodes, edges).collect()] == ["c2"]
    related = claims.related(nodes, edges, "c1", drafts=True).collect()
    assert [(r["id"], r["score"]) for r in related] == [("c2", 3.5)] and claims.related(nodes, edges, "c1").count() == 0
    assert claims.related(nodes, edges, "nothing").count() == 0
    assert {r["state"]: r["without_source"] for r in claims.diagnosis(nodes.where("id <> 'c3'"), edges).collect()} == {"accepted": 0, "draft": 1}


def test_store_and_stream(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.version == 0
    new = spark.createDataFrame([("a", 1)], "id string, n int")
    assert store.commit({"t": new}) == 1 and store.commit({"t": new.union(new)}) == 2 and store.commit({"t": new}, 2) == 2
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 1
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema("id string, n int, seq int").parquet(source)
    store.vacuum(1)
    assert store.read("t").count() == 2 and not (tmp_path / "store" / "v1").exists()
    target = UpsertLog(spark, str(tmp_path / "target"), ["id"])
    for batch in ([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], [("a", 3, 1), ("c", 1, 1)]):
        spark.createDataFrame(batch, "id string, n int, seq int").coalesce(1).write.mode("append").parquet(source)
        ingest.upserts(stream(), target, ["n"], str(tmp_path / "marks")).awaitTermination()
    want = [("a", 3), ("b", 1), ("c", 1)]
    assert sorted(map(tuple, target.read().collect())) == want and target.batches() == [0, 1]
    target.write(new, 1)  # a repeated batch changes nothing
    target.compact()
    assert sorted(map(tuple, target.read().collect())) == want


def test_windows_are_kept_in_a_log_and_closed_ones_in_files(spark, tmp_path):
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema("at timestamp, kind string").parquet(source)
    log = UpsertLog(spark, str(tmp_path / "log"), ["start", "kind"])
    for hours in ([0, 0, 1], [1, 5], [6, 0]):  # the last 0 is late: its window's state is gone
        rows = spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in hours])).alias("h")).select(F.timestamp_add("HOUR", "h", F.lit("2024-01-01").cast("timestamp")).alias("at"), F.lit("k").alias("kind"))
        rows.coalesce(1).write.mode("append").parquet(source)
        ingest.to_log(ingest.windowed_counts(stream(), "at", ["kind"]), log, str(tmp_path / "a")).awaitTermination()
        ingest.to_files(ingest.windowed_counts(stream(), "at", ["kind"]), str(tmp_path / "files"), str(tmp_path / "b")).awaitTermination()
    assert sorted((r["start"].hour, r["n"]) for r in log.read().collect()) == [(0, 2), (1, 2), (5, 1), (6, 1)]
    assert sorted((r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "files")).collect()) == [(0, 2), (1, 2)]
