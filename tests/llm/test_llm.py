"""The ten operators: brute force, round trips, held-out accuracy, and odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import contamination, language, ngram_join, pieces, pseudonyms, queries, secrets, shards, substrings, topk, toxicity
from lodestone.llm.components import components

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, place long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 7) for i, t in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a null id, a very long text; extra columns with inner names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return made(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (None, "word"), (5, long), (6, "123 !!"), (7, "a b c d e f " * 20)])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.where("a > 999")).count() == 0


def test_language_held_out(spark, docs):
    out = queries.op1_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_spans_scripts_and_odd(spark, odd):
    learn = made(spark, [(i, "the cat and the dog with this house") for i in range(20)]).unionByName(
        made(spark, [(i, "это мой дом и моя собака") for i in range(20, 40)]).withColumn("lang", F.lit("ru"))
    )
    model = language.train(learn)
    text = "the cat with this dog and the house это мой дом и моя собака это дом и собака"
    row = language.label(made(spark, [(1, text)]), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "ru"] and row["spans"][0]["end_word"] == 8
    out = language.label(odd, model).collect()
    assert len(out) == 9 and {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    nothing = language.train(learn.where("false"))
    assert {r["lang_pred"] for r in language.label(odd, nothing).collect()} == {"und"}


def test_viterbi_equals_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = [rng.normal(size=(int(rng.integers(1, 7)), 3)) * 3 for _ in range(5)]
        for scores, path in zip(s, language.viterbi(s, 2.0), strict=True):
            cost = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p[:-1], p[1:], strict=True))  # noqa: B023, E731
            best = max(cost(p) for p in np.ndindex(*[3] * len(scores)))
            assert cost(tuple(path)) == pytest.approx(best)


def plain_label(model, text, langs):
    """Word scores by the model, then the best labelling by dynamic programming over all words, one by one."""
    words = (text or "").split()
    scores, letters = model.words([w.strip(language._OUTER).lower() for w in words])
    total = int(letters.sum())
    if not total:
        return "und", 0.0
    best, came = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(langs)), key=lambda k: best[k])
        step = [k if best[k] >= best[top] - model.switch_penalty else top for k in range(len(langs))]
        best = [best[j] - (model.switch_penalty if j != k else 0) + row[k] for k, j in enumerate(step)]
        came.append(step)
    at = max(range(len(langs)), key=lambda k: best[k])
    path = [at]
    for step in came[::-1]:
        at = step[at]
        path.append(at)
    share = collections.Counter()
    for k, n in zip(path[::-1], letters.tolist(), strict=True):
        share[k] += n
    first = min(share, key=lambda k: (-share[k], k))
    return langs[first], share[first] / total


def test_language_query_against_plain_labeller(spark, docs):
    model = language.train(docs.where(~queries._held("doc_id", 4, 2)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op1_language_id(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        lang, score = plain_label(model, texts[r["doc_id"]], model.langs)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score)


def test_language_many_rare_and_tied(spark, odd):
    many = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} word", f"l{i:03d}") for i in range(200)], "doc_id long, text string, lang string")
    model = language.train(many)
    assert len(model.langs) == 200
    found = language.label(many, model).collect()
    assert {r["lang_pred"] for r in found} <= set(model.langs) and len({r["lang_pred"] for r in found}) > 100
    same = made(spark, [(1, "same words here")]).unionByName(made(spark, [(2, "same words here")]).withColumn("lang", F.lit("de")))
    assert language.label(same, language.train(same)).first()["lang_pred"] == "de"
    common = made(spark, [(i, "the cat sat on the mat") for i in range(3000)])
    rare = made(spark, [(9000 + i, "жук") for i in range(2)]).withColumn("lang", F.lit("ru"))
    assert language.train(common.unionByName(rare), rows_a_language=50).langs == ["en", "ru"]
    assert language.label(odd.where("false"), model).count() == 0
    clash = odd.selectExpr("doc_id", "text", "lang as lang_pred", "key as score", "place as spans")
    out = language.label(clash, model, keep=["doc_id", "lang_pred", "score"], names=("p", "s", "x"))
    assert out.columns == ["doc_id", "lang_pred", "score", "p", "s", "x"] and out.count() == 9


def test_topk_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)] + [(300, None), (301, [1.0, None] + [0.0] * 4), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.0] * 6), (299, [0.5] * 6)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(v, v.where("vec_id % 50 = 0"), 5, block_rows=64).collect()
    all_ = [(r["vec_id"], np.array(r["v"])) for r in v.collect()]
    for q, x in all_:
        if q % 50 == 0:
            want = sorted(((-int(x @ y), i) for i, y in all_ if i != q))[:5]
            assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert topk.top_k(v.where("false"), v.where("vec_id = 0"), 5).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load()


def test_pieces_against_plain_viterbi(model):
    usable = {p: s for p, s, kind in model.pieces if kind in (1, 4)}

    def best(text):
        now = [(0.0, None)] + [None] * len(text)
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + 20) + 1):
                s = usable.get(text[i:j], model.worst - 10 if j == i + 1 else None)
                if s is not None and (now[j] is None or now[i][0] + s > now[j][0]):
                    now[j] = (now[i][0] + s, i)
        return now[-1][0]

    codec = pieces.Codec(model)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("the onand  ñ.,\n日x") for _ in range(rng.randrange(1, 30)))
        ids = codec.encode(text)
        score = unknown = 0
        for i in ids:
            p, s, kind = model.pieces[i]
            score += s if kind != 6 else 0
        unknown = sum(c not in usable for c in "▁" + text.replace(" ", "▁"))
        assert score + unknown * (model.worst - 10) == pytest.approx(best("▁" + text.replace(" ", "▁")))
        assert codec.decode(ids) == text


def test_pieces_odd_and_round_trip(spark, odd, docs, model):
    coded = pieces.encode(odd, model)
    back = pieces.decode(coded, model).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back if r["text"] is not None) == sorted((r["doc_id"] or -1, r["text"]) for r in odd.collect() if r["text"] is not None)
    out = pieces.encode_digest(docs, model).collect()
    assert all(r["round_trip"] for r in out)
    assert pieces.encode(odd.where("false"), model).count() == 0


def test_shards_law(spark, odd, docs):
    for df in (docs, odd, made(spark, [(1, "same")] * 500 + [(2, "x" * 100)])):
        out = shards.sharded(df, 8, least_ranges=16, slack=0.0).collect()
        assert len(out) == df.count()
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r)
        most = max(r["size"] for r in out)
        sums = [sum(r["size"] for r in by[s]) for s in range(8)]
        assert max(sums) - min(sums) < 2 * most
        assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in shards.sharded(docs, 8).collect():
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert shards.sharded(odd.where("false")).count() == 0


def test_shards_keep_groups_that_fit(spark):
    rows = [(i, f"group {i // 4} " + "x" * (i // 4 % 7)) for i in range(4000)] + [(9000 + i, "hot") for i in range(6000)]
    for slack in (0.01, 0.0):
        out = shards.sharded(made(spark, rows), 8, least_ranges=8, slack=slack).collect()
        text = dict(rows)
        found = collections.defaultdict(set)
        for r in out:
            found[text[r["doc_id"]]].add(r["shard"])
        cut = [t for t, s in found.items() if len(s) > 1]
        sums = collections.Counter()
        for r in out:
            sums[r["shard"]] += r["size"]
        assert max(sums.values()) - min(sums.values()) <= 2 * (20 + slack * sum(sums.values()) / 8)
        if slack:
            assert set(cut) <= {"hot"}
        slots = collections.defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_subdivide_overfull_ranges(spark):
    """A third of the rows are one text, and one sample a range misses them: rounds go on until no range is overfull."""
    rows = [(i, f"t{i}") for i in range(2000)] + [(5000 + i, None) for i in range(1000)] + [(7000, "y" * 30_000)]
    sized = made(spark, rows).select((F.coalesce(F.length("text"), F.lit(0)) + 1).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), F.col("doc_id").alias("k2"), F.lit(0).alias("k3"))
    total, n = sized.agg(F.sum("size"), F.count("*")).first()
    out, rounds = shards._ranged(sized, total, n, 50, 1, 1)
    held = out.collect()
    sizes = collections.Counter(r["range"] for r in held)
    assert rounds > 1 and len(held) == 3001 and max(sizes.values()) <= 2 * 3001 // 61
    order = sorted(held, key=lambda r: (r["k1"], r["k2"], r["k3"]))
    assert [r["range"] for r in order] == sorted(r["range"] for r in held)


def brute_repeats(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d if d is not None else -1, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings_brute_force(spark, odd):
    rng = random.Random(4)
    passage = [[f"p{k}w{i}" for i in range(60)] for k in range(4)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passage)
            a = rng.randrange(30)
            w += p[a : a + rng.randrange(10, 60)] + [f"u{rng.randrange(40)}" for _ in range(rng.randrange(12))]
        rows.append((d, " ".join(w)))
    rows += [(200, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (201, "z " * 90), (202, None)]
    for df in (made(spark, rows), odd):
        have = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.without_repeats(df, 35).collect())
        assert got == brute_repeats(have, 35)
    assert substrings.without_repeats(odd.where("false")).count() == 0


def test_pseudonyms(spark, odd):
    text = "ssn 123-45-6789 on 2024-02-29 and 24.12.2020, call +1 (988) 555-2485 or (212) 555-0123, card 4111 1111 1111 1111 ip 10.1.2.3 mail jo.doe42@mail1.example.com"
    kept = "v4.0, 2.0. 256.1.1.1 and 4111-1111-1111-1112, 000-12-3456, 2023-02-30"
    df = made(spark, [(1, text), (2, text + " again"), (3, kept), (4, None), (5, "")])
    out = pseudonyms.pseudonymised(df, "k")
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["pii_kinds"] == ["ssn", "date", "date", "phone", "phone", "card", "ip", "email"]
    assert got[2]["text"] == got[1]["text"] + " again" and got[3]["text"] == kept and got[4]["text"] is None and got[5]["text"] == ""
    for value in ("123-45-6789", "2024-02-29", "988", "4111 1111 1111 1111", "10.1.2.3", "jo.doe42"):
        assert value not in got[1]["text"]
    digits = re.search(r"card ([0-9 ]+) ip", got[1]["text"])[1].replace(" ", "")
    assert len(digits) == 16 and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits)) % 10 == 0
    back = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymised(out.drop("pii_kinds"), "k", restore=True).collect()}
    assert back == {r["doc_id"]: r["text"] for r in df.collect()}
    assert pseudonyms.pseudonymised(odd, "k").count() == 9
    assert "Python" not in out._jdf.queryExecution().toString()


def plain_feistel(cells, key, kind, sign):
    v, r, h = [c[0] for c in cells], [c[1] for c in cells], len(cells) // 2
    for n in range(pseudonyms.ROUNDS)[::sign]:
        left = n % 2 == 0
        mine, rest = (range(h), v[h:]) if left else (range(h, len(v)), v[:h])
        told = "|".join([key, kind, str(n), ",".join(map(str, rest))])
        digest = "".join(hashlib.sha512(f"{told}|{j}".encode()).hexdigest() for j in range(len(v)))
        for k, i in enumerate(mine):
            v[i] = (v[i] + sign * int(digest[8 * k : 8 * k + 8], 16)) % r[i]
    return v


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_pseudonym(m, key):
    """(kind, pseudonym) of one candidate, or None where it isn't valid."""
    import calendar
    from datetime import date, timedelta

    put = lambda new: "".join(next(it) if c.isdigit() else c for it in [iter(new)] for c in m)
    digits = [int(c) for c in m if c.isdigit()]
    if re.fullmatch(pseudonyms.EMAIL, m):
        local, at, domain = m.partition("@")
        chars = [c for c in local if c.isalnum()]
        least = [48 if c.isdigit() else 65 if c.isupper() else 97 for c in chars]
        new = plain_feistel([(ord(c) - a, 10 if c.isdigit() else 26) for c, a in zip(chars, least, strict=True)], key, "email", 1)
        it = iter(chr(v + a) for v, a in zip(new, least, strict=True))
        return "email", "".join(next(it) if c.isalnum() else c for c in local) + at + domain
    if re.fullmatch(pseudonyms.IP, m):
        octets = [int(x) for x in m.split(".")]
        return ("ip", ".".join(map(str, plain_feistel([(x, 256) for x in octets], key, "ip", 1)))) if max(octets) < 256 else None
    if re.fullmatch(pseudonyms.DATE, m):
        x = [int(p) for p in re.split("[-/.]", m)]
        orders = [(0, 1, 2)] if m[4] == "-" else [(2, 1, 0)] if m[2] == "." else [(2, 1, 0), (2, 0, 1)]
        for order in orders:
            y, mo, d = (x[i] for i in order)
            if 1 <= mo <= 12 and 1 <= y and 1 <= d <= calendar.monthrange(y, mo)[1]:
                n = (date(y, mo, d) - date(1800, 1, 1)).days
                if not 0 <= n < 146_097:
                    return None
                a, b = plain_feistel([(n // 773, 189), (n % 773, 773)], key, "date", 1)
                to = date(1800, 1, 1) + timedelta(days=a * 773 + b)
                parts = [f"{to.year:04d}", f"{to.month:02d}", f"{to.day:02d}"]
                out = [""] * 3
                for i, p in zip(order, parts, strict=True):
                    out[i] = p
                return "date", re.sub("[0-9]+", lambda _, it=iter(out): next(it), m)
        return None
    if re.fullmatch(pseudonyms.SSN, m):
        a, g, s = (int(x) for x in m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        a, g, s = plain_feistel([(a - 1 if a < 666 else a - 2, 898), (g - 1, 99), (s - 1, 9999)], key, "ssn", 1)
        return "ssn", f"{a + 1 if a < 665 else a + 2:03d}-{g + 1:02d}-{s + 1:04d}"
    if re.fullmatch(r"[2-6](?:[ -]?[0-9]){12,18}", m) and luhn([c for c in m if c.isdigit()]):
        lead = [digits[0], *plain_feistel([(d, 10) for d in digits[1:-1]], key, "card", 1)]
        return "card", put([*map(str, lead), next(str(c) for c in range(10) if luhn("".join(map(str, [*lead, c]))))])
    plus = m.startswith("+")
    american = not plus or len(digits) == 11 and digits[0] == 1
    kept = int(plus) if american else 2
    rest = digits[kept:]
    if american and not re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", "".join(map(str, rest))):
        return None
    least = [2 if american and i in (0, 3) else 0 for i in range(len(rest))]
    new = plain_feistel([(d - a, 10 - a) for d, a in zip(rest, least, strict=True)], key, "phone", 1)
    return "phone", put([*map(str, digits[:kept]), *(str(v + a) for v, a in zip(new, least, strict=True))])


def plain_pseudonyms(text, key):
    """Scans a text by the docstring's formats: valid cards first, then all formats in their order from left to right."""
    p = pseudonyms
    cards = {m[1] for form in p.CARD_FORMS for m in re.finditer(f"(?<![0-9])(?=({form})(?![0-9]))", text) if luhn([c for c in m[1] if c.isdigit()])}

    def pattern(cards):
        held = [r"(?<![0-9])(?:" + "|".join(map(re.escape, sorted(cards, key=lambda c: order(c)))) + ")(?![0-9])"] if cards else []
        other = "|".join([p.IP, p.DATE, p.SSN, p.PLAIN, *held])
        foreign = rf"\+[0-9](?:(?![ .()-]{{1,2}}(?:{other}))[ .()-]{{0,2}}[0-9]){{7,14}}(?![0-9])|\+[0-9](?:[ .()-]{{0,2}}[0-9]){{7,14}}(?![0-9])"
        return "|".join([p.EMAIL, p.IP, p.DATE, p.SSN, *held, p.PLUS_ONE, foreign, p.PLAIN])

    def order(card):
        at = [(i, m.start()) for i, form in enumerate(p.CARD_FORMS) for m in re.finditer(f"(?<![0-9])(?=({form})(?![0-9]))", text) if m[1] == card]
        return min(at, default=(len(p.CARD_FORMS), text.find(card)))

    left = re.sub(pattern(cards), "#", text)
    cards |= {m[0] for m in re.finditer(p.CARD, left) if luhn([c for c in m[0] if c.isdigit()])}
    kinds = []

    def new(m):
        found = plain_pseudonym(m[0], key)
        kinds.append(found and found[0])
        return found[1] if found else m[0]

    return re.sub(pattern(cards), new, text), [k for k in kinds if k]


def test_pseudonyms_query_against_plain_scan(spark, docs):
    out = {r["doc_id"]: r for r in queries.op6_pii_pseudonyms(spark, DATA).collect()}
    key, seen = queries.pii_key(spark), collections.Counter()
    for r in docs.collect():
        text, kinds = plain_pseudonyms(r["text"], key)
        assert out[r["doc_id"]]["text"] == text and out[r["doc_id"]]["n_values"] == len(kinds)
        seen.update(kinds)
    assert len(seen) >= 4


def test_pseudonyms_link_notations_and_odd(spark):
    forms = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "+1 (212) 555-0123", "212-555-0123", "(212) 555-0123", "Jo.Doe@x.example.com", "jo.doe@x.example.com"]
    df = made(spark, list(enumerate(forms))).withColumnsRenamed({"key": "_found", "place": "_new", "source": "pii_kinds"})
    out = pseudonyms.pseudonymised(df, "k").orderBy("doc_id").collect()
    digits = [re.sub("[^0-9]", "", r["text"]) for r in out]
    assert digits[0] == digits[1] == digits[2] and digits[3][1:] == digits[4] == digits[5]
    assert out[6]["text"].lower() == out[7]["text"] and all((r["_found"], r["_new"]) == ("clash", 7) for r in out)
    assert [r["pii_kinds"] for r in out] == [["card"]] * 3 + [["phone"]] * 3 + [["email"]] * 2
    assert pseudonyms.pseudonymised(df.where("false"), "k").count() == 0


def test_pseudonyms_beside_other_numbers(spark):
    card, phone, ip = "4111 1111 1111 1111", "+1 (826) 555-4081", "190.137.223.204"
    alone = {v: pseudonyms.pseudonymised(made(spark, [(1, v)]), "k").first()["text"] for v in (card, card.replace(" ", ""), phone, ip, "(212) 555-0123", "2024-02-29", "+49 30 1234567")}
    forms = [
        "{0} 123 now", "{1} 12/27", "order 5 {0}", "12 {0} 7", "{1} {3}", "{0} {3}", "{2} {3}", "{2} 5", "{3} {2}", "{5} {0}", "7 {2} {0} {3}",
        "{6} {3}", "{6} {5}", "{6} {0}", "{6} {4}", "{0} {0}", "{1} {1}", "{4} {4}", "{0} {5}", "5 {5} 10 11 12 {4}",
    ]
    plain, new = list(alone), list(alone.values())
    df = made(spark, [(i, f.format(*plain)) for i, f in enumerate(forms)])
    out = pseudonyms.pseudonymised(df, "k")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: f.format(*new) for i, f in enumerate(forms)}
    assert all(a != b for a, b in alone.items())
    odd = pseudonyms.pseudonymised(made(spark, [(1, "41 11 111 11111 1111"), (2, "+41 44.123.45.67"), (3, "+1 5551234")]), "k")
    assert [r["pii_kinds"] for r in odd.orderBy("doc_id").collect()] == [["card"], ["phone"], ["phone"]]
    back = pseudonyms.pseudonymised(out.drop("pii_kinds"), "k", restore=True)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in df.collect())


def test_myers_and_contamination(spark, odd):
    def distance(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
            row = new
            best = min(best, row[-1])
        return best

    rng = random.Random(5)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in "pt")
        assert contamination.myers(contamination.masks(p), len(p), t)[0] == distance(p, t)
    item = "the quick brown fox jumps over the lazy dog while seventeen green birds are looking on"
    bench = spark.createDataFrame([(1, item), (2, None), (3, " "), (4, "tiny")], "item_id long, text string")
    near = item.replace("brown", "brawn").replace("birds", "bird")
    df = made(spark, [(1, "so " + item.upper() + " ok"), (2, "xx " + near), (3, "fox dog birds"), (4, None), (5, item[:40])])
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in contamination.contaminated(df, bench).collect()}
    assert got == {(1, 1): 0, (2, 1): 2}
    assert sorted(r["doc_id"] for r in contamination.decontaminated(df, bench).collect()) == [3, 4, 5]
    assert contamination.contaminated(odd, bench).count() == 0
    assert contamination.decontaminated(odd, bench.where("false")).count() == 9


def plain_distance(item, text):
    """Least edit distance of the item to any part of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (x != c))
        best = min(best, row[-1])
    return best


def test_contamination_against_plain_distances(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 12, 14, 16])]
    items += [(90, items[4][1]), (None, items[5][1]), (91, "a"), (92, None)]
    rows = []
    for d in range(60):
        text = list(" ".join(rng.choice(words) for _ in range(5)) + " " + rng.choice(items[:8])[1] + " " + " ".join(rng.choice(words) for _ in range(5)))
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "q", "xy", " "])
        rows.append((d, "".join(text).upper() if d % 3 else "".join(text)))
    rows += [(0, rows[0][1]), (None, rows[1][1]), (70, None), (71, "")]
    want = []
    for d, text in rows:
        text = contamination.normalised(text or "")
        for key, item in items:
            item = contamination.normalised(item or "")
            if len(item) < 12:
                continue
            k = int(len(item) * 0.05) if len(item) >= 40 else 0
            least = plain_distance(item, text)
            if least <= k and (len(item) >= 40 or re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text)):
                want.append((d if d is not None else -1, key if key is not None else -1, least))
    df, bench = made(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 40 and len({w[2] for w in want}) > 2
    for block_chars in (contamination.BLOCK_CHARS, 150):
        got = contamination.contaminated(df, bench, block_chars=block_chars).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"] if r["item_id"] is not None else -1, r["distance"]) for r in got) == sorted(want)
        clean = contamination.decontaminated(df, bench, block_chars=block_chars)
        assert clean.columns == df.columns
        bad = {w[0] for w in want}
        assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in clean.collect()) == sorted(x for x in ((d if d is not None else -1) for d, _ in rows) if x not in bad)
    assert contamination.contaminated(df.where("false"), bench).count() == 0


def test_contamination_query_against_plain_distances(spark, docs):
    """The whole query: every document of the table that holds any piece of an item is measured in full."""
    items = [(r["item_id"], contamination.normalised(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op7_decontamination(spark, DATA).collect()}
    want = {}
    for r in docs.collect():
        text = contamination.normalised(r["text"])
        for key, item in items:
            k = int(len(item) * 0.05) if len(item) >= 40 else 0
            hits = [m.start() - a for a, piece in contamination.pieces(item, k) for m in re.finditer(f"(?={re.escape(piece)})", text)]
            if hits:
                least = min(plain_distance(item, text[max(0, h - k - 1) : h + len(item) + k + 1]) for h in set(hits))
                if least <= k:
                    want[r["doc_id"], key] = least
    assert got == want and want


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d if d is not None else -1, len(s), least.get(root(i), -1) if s else (d if d is not None else -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("hot", "block"), [(32, 128), (3, 8)])
def test_groups_brute_force(spark, odd, hot, block, monkeypatch):
    rng = random.Random(6)
    rows = []
    for d in range(150):
        base = [f"b{d % 3}w{i}" for i in range(80)]
        for _ in range(rng.randrange(5)):
            base[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(base) if d % 5 else " ".join(f"r{rng.randrange(50)}" for _ in range(rng.randrange(9)))))
    rows += [(300, rows[1][1].upper()), (None, rows[1][1]), (301, None), (302, "")]
    plain = ngram_join.links
    monkeypatch.setattr(ngram_join, "links", lambda *a, **k: plain(*a, **k, hot=hot, block=block))
    for df in (made(spark, rows), odd):
        have = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in ngram_join.grouped(df).collect())
        assert got == brute_groups(have)
    assert ngram_join.grouped(odd.where("false")).count() == 0


def plain_clause(kinds, weights):
    """Sums by feature, from the rules as the docstring says them: no states."""
    t, sums = toxicity, [0.0] * 5
    after = lambda i: kinds[i] if i < len(kinds) else t.OTHER
    for i, kind in enumerate(kinds):
        negated = t.NEGATION in kinds[max(0, i - t.SCOPE) : i]
        reported = t.REPORT in kinds[:i]
        factor = (t.WEAKER[t.NEGATED] if negated else 1) * (t.WEAKER[t.REPORTED] if reported else 1)
        place = 2 if negated else 3 if reported else None
        if kind == t.INSULT:
            targeted = any(k in (t.ADDRESS, t.OBJECT, t.POSSESSIVE) for k in kinds)
            sums[place or int(targeted)] += weights[i] * factor * (t.STRONGER if targeted else 1)
        if kind == t.HARM:
            modal = t.MODAL in kinds[max(0, i - t.MODAL_REACH) : i]
            one, two = after(i + 1), after(i + 2)
            person = (t.ADDRESS, t.OBJECT)
            stops = (t.HARM, t.ARTICLE)
            hit = modal and t.OBJECT in kinds[max(0, i - t.OBJECT_REACH) : i]
            hit = hit or one in person or one == t.POSSESSIVE and two == t.KIN or one not in (*stops, t.POSSESSIVE) and two in person
            if hit:
                sums[place or 4] += (t.MODAL_THREAT if modal else t.THREAT) * factor
    return sums


def test_groups_verify_each_pair_once(spark, monkeypatch):
    """Over all tasks of both kinds no pair of classes is measured twice, though many share rare and frequent n-grams."""
    rng = random.Random(10)
    rows = []
    for d in range(90):
        base = [f"c{d % 2}w{i}" for i in range(160)]
        for _ in range(3):
            base[rng.randrange(12) * 13] = f"e{rng.randrange(3)}"
        rows.append((d, " ".join(base)))
    df = made(spark, rows)
    _, firsts = ngram_join.classes(df)
    plain, seen = ngram_join.overlaps, set()
    class Common:
        value = ngram_join.common_tokens(df, 5)

    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda self, f, schema: self._df)
    monkeypatch.setattr(ngram_join, "discard", lambda df, sweep=True: None)
    dealt = ngram_join.links(df, firsts, hot=6, block=16).collect()
    monkeypatch.undo()
    monkeypatch.setattr(ngram_join, "overlaps", lambda x, y, percent: pairs.append((x.tobytes(), y.tobytes())) or plain(x, y, percent))
    by = collections.defaultdict(list)
    for r in dealt:
        by[r["kind"], r["cluster"], r["i"], r["j"]].append(r)
    import pandas as pd

    kinds = set()
    for key, members in by.items():
        pairs = []
        ngram_join._items(5, 80, Common)(key, pd.DataFrame([r.asDict() for r in members]))
        for x, y in pairs:
            assert frozenset((x, y)) not in seen
            seen.add(frozenset((x, y)))
        kinds |= {key[0]} if pairs else set()
    assert kinds == {ngram_join.PAIRS, ngram_join.BLOCKS} and len(seen) > 50


def test_toxicity_grammar_against_plain_rules():
    rng = random.Random(8)
    forward, backward = toxicity.grammar()
    for _ in range(3000):
        kinds = [rng.choice([0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]) for _ in range(rng.randrange(1, 12))]
        weights = [rng.choice([3.0, 5.0]) if k == toxicity.INSULT else 0.0 for k in kinds]
        sums = [0.0] * 5
        for feature, weight in toxicity.read_clause(forward, backward, kinds, weights):
            sums[feature] += weight
        assert sums == pytest.approx(plain_clause(kinds, weights)), kinds


def plain_features(model, text):
    """Token by token and clause by clause, with the rules of plain_clause."""
    import math

    clauses, now = [], []
    for token in (text or "").lower().replace("\u2019", "'").split():
        now.append(model.classify(token))
        if token[-1] in ".!?;:,":
            clauses, now = [*clauses, now], []
    sums, best, n = [0.0] * 5, 0.0, 0
    for clause in [*clauses, now]:
        kinds, weights = [k for k, _ in clause], [w if k == toxicity.INSULT else 0.0 for k, w in clause]
        found = plain_clause(kinds, weights)
        sums = [a + b for a, b in zip(sums, found, strict=True)]
        best = max(best, sum(found))
        n += sum(k == toxicity.INSULT for k in kinds)
    return sums, best, n, math.log1p


def test_toxicity_query_against_plain_reading(spark, docs):
    """Every document's score from its clauses, read by the plain rules with the model that the query learns."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels.where(~queries._held("doc_id", 5, 0)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op9_toxicity(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        sums, best, n, log = plain_features(model, texts[r["doc_id"]])
        threats = sums[4] > 0 or any(k == toxicity.HARM for t in (texts[r["doc_id"]] or "").lower().split() for k in [model.classify(t)[0]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
        if not threats:  # without harm verbs the number of matches is that of the insults
            x = np.array([[*map(log, sums), log(best), log(n)]])
            assert r["score"] == pytest.approx(float(model.score(x)[0]))


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = queries.op9_toxicity(spark, data).join(labels, "doc_id").where("held_out").collect()
    clean, toxic = ([r["predicted"] for r in out if r["toxic"] == k] for k in (0, 1))
    assert sum(clean) / len(clean) < 0.01 and sum(toxic) / len(toxic) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_toxicity_pairs_and_odd(spark, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.ToxicModel({"idiot": 7.0}, {"lowei": 6.0})
    cases = [
        "you are an idiot.", "you are not an idiot.", "he said: nothing. fine", "she wrote you idiot", "loweiung", "an idiot",
        "I will kill you", "We must kill the process and restart you", "I will not kill you", "he said I will kill you", "kill the process",
        "ich werde dich töten", "we will strangle your family", "we will strangle your process", "Je vais te tuer", "you will kill it",
    ]
    score = [r["score"] for r in toxicity.scored(made(spark, list(enumerate(cases))), model).orderBy("doc_id").collect()]
    low = score[2]
    assert score[0] > 0.5 > score[1] > low and score[3] < score[0] and score[0] > score[5] > low and score[4] > low
    assert score[6] > 0.9 and score[7] == score[10] == score[13] == score[15] == low and low < 0.06
    assert low < score[8] < 0.5 and low < score[9] < score[6]
    assert min(score[11], score[12], score[14]) > 0.9
    assert toxicity.scored(odd, model).count() == 9 and toxicity.scored(odd.where("false"), model).count() == 0
    assert all(r["score"] == toxicity.scored(made(spark, [(0, "")]), model).first()["score"] for r in toxicity.scored(odd, model).collect() if r["doc_id"] in (1, 2, 3))
    for kept in ("false", "toxic = 1"):  # nothing of one kind to learn from: no insults, threats by their prior weight
        untaught = toxicity.train(odd.withColumnRenamed("key", "_label"), labels.where(kept))
        assert not untaught.words and toxicity.scored(odd, untaught).count() == 9


def test_secrets_against_plain_scan(spark, odd, docs):
    def plain(text):
        out = []
        for k, r in enumerate(secrets.BASE_RULES + secrets.ADDED_RULES):
            out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII) if m.end(r.group) - m.start(r.group) >= r.least]
        return [f"{(secrets.BASE_RULES + secrets.ADDED_RULES)[k].name}:{a}:{b}" for a, k, b in sorted(out)]

    rng = random.Random(7)
    bits = ["PassWord", "passwd", "API_KEY", "apikey", "token", ' = "', ": ", "='", "AKIA", "ABCDEFGH", "0123456789abcdef", "deadbeef" * 4, "é", " ", "secret", "/x.y", "ghp_", "a" * 36, "ſecret=", "-----BEGIN PRIVATE KEY-----"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for i in range(400)]
    for df in (made(spark, rows), odd, docs):
        have = sorted((r["doc_id"] or -1, ",".join(plain(r["text"]))) for r in df.collect())
        got = secrets.digest(secrets.scan(df)).collect()
        assert sorted((r["doc_id"] or -1, r["spans"]) for r in got) == have
        for r in got:
            base = [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex"))


def test_secrets_take_linear_time_and_empty_table(spark, odd):
    import time

    hard = ["eyJ" * 300_000, "eyJaaaaaaaa." * 80_000, "-----BEGIN " + "A" * 900_000, "xoxb-" * 180_000, "password" * 110_000, "0123456789abcdef" * 60_000, "AIza" * 220_000]
    began = time.time()
    assert secrets.scan(made(spark, list(enumerate(hard)))).count() == len(hard)
    assert len(secrets.scan(made(spark, list(enumerate(hard)))).collect()) == len(hard)
    assert time.time() - began < 30
    assert secrets.digest(secrets.scan(odd.where("false"))).count() == 0


def test_pipeline_rows_keep_their_number_when_splits_change(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    made(spark, [(i, f"text {i % 24}") for i in range(48)]).repartition(12, "doc_id").write.parquet(f"{tmp_path}/docs")
    key = "spark.sql.files.maxPartitionBytes"

    def grouped(docs, n, percent, *, id_col):
        rows = docs.select(id_col, "text").collect()
        first = {t: min(r[id_col] for r in rows if r["text"] == t) for t in {r["text"] for r in rows}}
        spark.conf.set(key, "4194304b")  # from here on each file is read by a task of its own
        return spark.createDataFrame([(r[id_col], first[r["text"]]) for r in rows], f"{id_col} long, component_id long")

    monkeypatch.setattr(ngram_join, "grouped", grouped)
    try:
        kept = corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    finally:
        spark.conf.unset(key)
    assert sorted(r["doc_id"] % 24 for r in kept) == list(range(24))


def test_pipeline_stages_against_plain_versions(spark, docs):
    """Each stage over the whole table, held against a plain version of what it decides."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    start = docs.unionByName(made(spark, [(-1, None), (-2, ""), (-3, "123 !!"), (-4, "der Hund the dog le chien el perro жук")]).select(docs.columns))
    one = stages["language ID"](spark, start, DATA)
    kept = {r["doc_id"]: r for r in one.collect()}
    assert set(kept) == {r["doc_id"] for r in start.collect() if r["text"] and any(c.isalpha() for c in r["text"])} and -4 in kept
    assert all(r["lang"] is not None for r in kept.values())
    two = stages["n-gram Jaccard join"](spark, one, DATA)
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    group = {d: c for d, _, c in brute_groups(rows)}
    left = [r["doc_id"] for r in two.collect()]
    assert len(left) == len(set(group.values())) and {group[d] for d in left} == set(group.values())
    three = stages["benchmark decontamination"](spark, two, DATA)
    leaked = {r["doc_id"] for r in queries.op7_decontamination(spark, DATA).collect()}
    assert {r["doc_id"] for r in three.collect()} == set(left) - leaked and leaked & set(left)
    four = stages["PII"](spark, three, DATA)
    before, key = {r["doc_id"]: r["text"] for r in three.collect()}, queries.pii_key(spark)
    after = {r["doc_id"]: r for r in four.collect()}
    assert {d: r["text"] for d, r in after.items()} == {d: plain_pseudonyms(t, key)[0] for d, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values()) and any(before[d] != r["text"] for d, r in after.items())
    five = stages["SentencePiece encoding and decoding"](spark, four, DATA)
    codec = pieces.Codec(pieces.PieceModel.load())
    coded = {r["doc_id"]: r for r in five.collect()}
    assert {d: codec.decode(r["token_ids"]) for d, r in coded.items()} == {d: r["text"] for d, r in after.items()}
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in coded.values())
    assert four.columns == start.columns and sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(set(coded) - {-4})


def test_pipeline_stages_take_odd_rows(spark, odd, docs):
    import corpus_pipeline

    clash = odd.withColumnsRenamed({"key": "_place", "place": "lang_pred"})
    want = {"language ID": 5, "n-gram Jaccard join": 7, "benchmark decontamination": 9, "PII": 9, "SentencePiece encoding and decoding": 9}
    for name, stage in corpus_pipeline.STAGES:
        assert (name, stage(spark, clash, DATA).count()) == (name, want[name])
        assert stage(spark, clash.where("false"), DATA).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert stage(spark, clash, DATA).columns == clash.columns
    untaught = corpus_pipeline.known_language(spark, clash.withColumn("lang", F.lit(None).cast("string")), DATA)
    assert untaught.count() == 5
