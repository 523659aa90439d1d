"""Operators on small tables: brute force, edge rows, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from strophe.llm import best_fit, decontaminate, graph, html_text, language, lm_score, near_dedup, pii, quality, token_files, tool_calls
from strophe.llm.common import fold, work_dir
from strophe.llm.queries import QUERIES, SQL, tokenizer_path
from strophe.llm.tokenise import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "su", "ve", "ran", "do", "pi", "es", "tion", "al", "en", "gra", "bo", "ul", "ist", "mo", "ne", "fi") for b in ("n", "ra", "tu", "lo", "se", "mer", "ko", "ti", "sta", "ve", "am", "or", "ig", "pul", "cha", "ex", "in", "da", "ro", "qu")]


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(seed, n_group):
    rng = random.Random(seed)
    base = say(rng, 120)
    texts = [edited(rng, base, rng.randint(0, 7)) for _ in range(n_group)] + [base, base, None, "", " \n", "one two", "One  TWO", "x"]
    texts += [say(rng, rng.randint(3, 150)) for _ in range(30)]
    shared = say(rng, 40)
    return texts + [f"{shared} {say(rng, 200)}" for _ in range(25)]


@pytest.mark.parametrize(("k", "block", "short"), [(4, 384, 32), (5, 384, 1000), (4, 16, 32), (5, 16, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, block, short):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", block)
    monkeypatch.setattr(near_dedup, "SHORT", short)
    texts = near_copies(k, 60)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, texts), k).collect()}
    truth = brute_components(list(enumerate(texts)), k)
    assert {i: r.component_id for i, r in got.items()} == truth
    assert all(r.n_shingles == len(shingles(texts[i], k)) and r.kept == (truth[i] == i) for i, r in got.items())


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(5)
    base = say(rng, 300)
    texts = [edited(rng, base, rng.randint(1, 6)) for _ in range(2000)] + [say(rng, 60) for _ in range(200)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, texts), 5).collect()}
    assert all(got[i] == (0 if i < 2000 else i) for i in range(2200))


def test_near_duplicates_edges(spark):
    same, near = "a b c d e f", " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, same, 0, "x"), (1, same, 0, "x"), (1, "other words here", 1, "y"), (2, same, 0, "z"), (3, "other words here", 0, ""), (None, same, 0, "z"), (None, None, 0, None), (4, " ", 0, "a"),
        (None, near, 0, ""), (None, f"{near} more", 0, ""), (5, "one only", 0, ""), (6, same + " " + say(random.Random(1), 30_000), 0, ""),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, node int, fp string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(d, 5).collect())
    assert [x[1:] for x in got if x[0] == 1] == [(1, 1, True), (2, 1, True), (2, 1, True)]
    assert [x[1:] for x in got if x[0] in (2, 3, 4)] == [(2, 1, False), (1, 1, False), (0, 4, True)]
    null = [x[1:] for x in got if x[0] == 0]
    assert null[:2] == [(0, 0, True), (2, 1, False)] and sorted(x[2] for x in null[2:]) == [False, True]
    left = [(r.doc_id, r.text) for r in near_dedup.deduplicate(d, 5).collect()]
    assert sorted(x or 0 for x, _ in left) == [0, 0, 1, 1, 4, 5, 6] and len({t for x, t in left if x is None}) == 2
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0 == near_dedup.deduplicate(table(spark, [])).count()


def test_near_duplicates_run_as_short_queries(spark, monkeypatch):
    """No query of the near-dedup has over three joins: the driver's memory goes with the longest."""
    joins = {}

    def count(df, name):
        joins[name] = len(re.findall(r"\bJoin (?:Inner|Left)", df._jdf.queryExecution().optimizedPlan().toString()))

    for module in (near_dedup, graph):
        written = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, folder, name, written=written: (count(df, name), written(df, folder, name))[1])
    chain = [" ".join(f"w{j}" for j in range(i, i + 80)) for i in range(0, 60, 3)]  # a path of links: several rounds
    d = table(spark, near_copies(6, 60) + chain)
    count(near_dedup.deduplicate(d, 5), "deduplicate")
    count(near_dedup.near_duplicates(d, 4), "near_duplicates")
    assert len([x for x in joins if "_ends" in x]) > 1 and 0 < max(joins.values()) <= 3, joins


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark, "t"), "c")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in linked}


def test_leaks_edges(spark):
    item = say(random.Random(2), 30)
    d = spark.createDataFrame([(1, f"x {item} y", "s"), (1, f"x {item} y", "s"), (2, "clean text of its own here", "s"), (None, item, "s"), (3, say(random.Random(3), 20_000) + " " + item, "s"), (4, None, None)], "doc_id long, text string, similarity string")
    b = spark.createDataFrame([(7, item, 1), (7, item, 2), (8, item, 1), (None, item, 1)], "item_id long, text string, hamming int")
    for size in (20_000, 1):
        got = sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.find(d, b, items_per_block=size).collect())
        assert got == sorted((i, j) for i in (1, 1, 0, 3) for j in (7, 8, 0))
        left = decontaminate.clean(d, b, items_per_block=size)
        assert sorted(r.doc_id for r in left.collect()) == [2, 4] and left.columns == d.columns
    assert decontaminate.find(d, b.limit(0)).count() == decontaminate.find(d.limit(0), b).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == 6


def brute_leaks(docs, items, k=5):
    from collections import Counter

    def weights(tokens):
        kk = min(k, len(tokens))
        out = Counter()
        for i in range(len(tokens) - kk + 1):
            out[tuple(tokens[i : i + kk])] += 1
        return {s: c * sum(map(len, s)) for s, c in out.items()}

    found = {}
    for d, text in docs:
        w = (text or "").encode().lower().split()
        for i, item in items:
            t = (item or "").encode().lower().split()
            own, kk = weights(t), min(k, len(t))
            for s in range(max(1, len(w) - len(t) + 1)) if t and len(w) >= kk else ():
                x = weights(w[s : s + len(t)]) if len(t) >= k else {tuple(w[s : s + kk]): sum(map(len, w[s : s + kk]))}
                keys = {*own, *x}
                v = sum(min(own.get(z, 0), x.get(z, 0)) for z in keys) / sum(max(own.get(z, 0), x.get(z, 0)) for z in keys)
                if v >= 0.8:
                    found[d, i] = max(found.get((d, i), 0), v)
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, say(rng, rng.randint(6, 60))) for i in range(20)] + [(20, "two words"), (21, None), (22, " "), (23, say(rng, 5))]
    docs = [(i, f"{say(rng, rng.randint(0, 80))} {edited(rng, items[i % 20][1], rng.randint(0, 2))} {say(rng, 30)}") for i in range(60)]
    docs += [(60, None), (61, ""), (62, "there are two words here"), (63, items[3][1]), (64, " ".join(items[4][1].split()[:-1])), (65, say(rng, 3000))]
    schema = "doc_id long, text string"
    d, b = spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string")
    truth = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(d, b).collect()}
    assert got.keys() == truth.keys() and all(v == pytest.approx(truth[x]) for x, v in got.items())
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.find(d, b, items_per_block=5).collect()}
    assert blocks == truth.keys()
    for size in (20_000, 5):
        left = decontaminate.clean(d, b, items_per_block=size)
        assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in truth}
    assert decontaminate.find(d.limit(0), b).count() == decontaminate.find(d, b.limit(0)).count() == 0


def feistel(left, right, a, b, key, kind):
    import hashlib

    h = lambda i, v: int(hashlib.sha256(f"{key}|{kind}|{i}|{v}".encode()).hexdigest()[:12], 16)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + h(i, right)) % a
        else:
            right = (right + h(i, left)) % b
    return left, right


def luhn(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms_equal_brute_force(spark):
    rng = random.Random(4)
    numbers = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(80)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(20)]
    d = table(spark, [f"x {n} y" for n in numbers] + [f"at {i}." for i in ips])
    got = {r.doc_id: r for r in pii.pseudonymise(d, "key").collect()}
    seen = set()
    for i, n in enumerate(numbers):
        new = got[i].text[2:-2]
        if luhn(n):
            left, right = feistel(int(n[:7]), int(n[7:15]), 10**7, 10**8, "key", "card")
            body = f"{left:07d}{right:08d}"
            assert new[:15] == body and luhn(new) and got[i].n_found == 1
            seen.add(new)
        else:
            assert new == n and got[i].n_found == 0
    assert len(seen) == sum(map(luhn, set(numbers)))
    for i, ip in enumerate(ips):
        o = list(map(int, ip.split(".")))
        left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "key", "ip")
        assert got[80 + i].text == f"at {left >> 8}.{left & 255}.{right >> 8}.{right & 255}."


CASES = ["ann.b-7@mail.example.org", "+1 (017) 555-7713", "10.0.255.1", "4845 1681 1440 7329", "2020-02-29", "31/12/1999", "123-45-6789", "DE89 3704 0044 0532 0130 00"]
INVALID = ["4845168114407328", "2021-02-30", "000-12-3456", "256.1.1.1", "1.2.3.4.5", "DE88370400440532013000", "a@b", "12/13/2020"]


def test_pseudonyms_keep_format_and_links(spark):
    d = table(spark, [f"a {c} b" for c in CASES] + [f"{c}; {c}!" for c in CASES] + INVALID + [None, "", "no data 12 34.5", "y" * 30_000])
    got = {r.doc_id: r for r in pii.pseudonymise(d, "k").collect()}
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    for i, c in enumerate(CASES):
        new = got[i].text[2:-2]
        assert new != c and got[i].n_found == 1
        if "." not in c or "@" in c:
            assert shape(new) == shape(c)
        assert got[len(CASES) + i].text == f"{new}; {new}!"
    for i, c in enumerate(INVALID):
        assert got[2 * len(CASES) + i].text == c
    last = 2 * len(CASES) + len(INVALID)
    assert [got[last + i].text for i in range(4)] == [None, "", "no data 12 34.5", "y" * 30_000]
    assert pii.pseudonymise(d.limit(0), "k").count() == 0
    plan = pii.pseudonymise(d, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert pii.pseudonymise(d, "other").first()["text"] != got[0].text


def test_mail_address_without_any_digit(spark):
    d = table(spark, ["write to jane.doe@example.com today", "jane.doe@example.com, room 4", "no mail @ all"])
    got = {r.doc_id: r for r in pii.pseudonymise(d, "k").collect()}
    new = got[1].text.removesuffix(", room 4")
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}@example\.com", new) and new != "jane.doe@example.com"
    assert (got[0].text, got[0].n_found, got[1].n_found) == (f"write to {new} today", 1, 1)
    assert (got[2].text, got[2].n_found) == ("no mail @ all", 0)


CARD, BANK = "4111 1111 1111 1111", "BE68 5390 0754 7034"


BEHIND = [
    (f"card {CARD} 123 cvv", [CARD]), (f"x {CARD} 10 items", [CARD]), (f"{CARD} 10.1.2.3", [CARD, "10.1.2.3"]), (f"{CARD}-10", [CARD]), (f"{BANK} THIS month", [BANK]), (f"{BANK} 2020 AND 2021 TOO", [BANK]),
    (f"1234 {CARD} z", [CARD]), (f"{CARD} {CARD} 99 a@b.com", [CARD, CARD, "a@b.com"]), ("call 212-555-1234, 212.555.1234", ["212-555-1234", "212.555.1234"]), ("+44 20 7946 0958.", ["+44 20 7946 0958"]),
    ("+1 212 555 1234 12 items", ["+1 212 555 1234"]), ("at 2024-05-06T10:00", ["2024-05-06"]), (f"\ue000v\ue001 {CARD} 1 \ue001\ue000a", [CARD]), ("1234 5678 9012 3456 7891", []), (f"{CARD} 1 " + "x" * 100_000, [CARD]),
]


def test_pseudonyms_of_values_with_numbers_behind(spark):
    """Each value as it is replaced where it stands alone; all else stays. Twice, as repeated rows are treated alike."""
    values = sorted({v for _, vs in BEHIND for v in vs})
    got = [(r["text"], r["n_found"]) for r in pii.pseudonymise(table(spark, values + 2 * [t for t, _ in BEHIND]), "k").orderBy("doc_id").collect()]
    alone = dict(zip(values, (t for t, _ in got), strict=False))
    assert all(v != new for v, new in alone.items())
    for (text, own), one, two in zip(BEHIND, got[len(values) :], got[len(values) + len(BEHIND) :], strict=False):
        for v in dict.fromkeys(own):
            text = text.replace(v, alone[v])
        assert one == two == (text, len(own))


def test_letters_beyond_ascii_in_mail_addresses(spark):
    got = [r.text for r in pii.pseudonymise(table(spark, ["josé@x.com", "ÉÜ@x.com"]), "k").collect()]
    assert re.fullmatch("[a-z]{3}[ß-öø-ÿ]@x.com", got[0]) and got[0][3] != "é" and re.fullmatch("[À-ÖØ-Þ]{2}@x.com", got[1])


def test_repeated_rows_do_not_crowd_a_language_out(spark):
    rng = random.Random(8)
    for trial in range(3):
        rows = [(1, f"le chat {trial} est sur la table", "fr")] * 3000 + [(i, say(rng, 20), "en") for i in range(200)] + [(7, "der Hund", "de")] * 1500 + [(i, say(rng, 5), "xx") for i in range(1000, 2500)]
        learnt = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert sorted(learnt) == ["de", "en", "fr", "xx"] and learnt["fr"].decode() == "le chat est sur la table"


def test_dates_are_permuted(spark):
    from datetime import date, timedelta

    days = [(date(1900, 1, 1) + timedelta(days=i)).isoformat() for i in range(0, 73049, 41)]
    new = [r.text for r in pii.pseudonymise(table(spark, days), "k").collect()]
    assert len(set(new)) == len(days) and all(date.fromisoformat(x).year in range(1900, 2100) for x in new)


def test_token_files_round_trip(spark):
    rng = random.Random(2)
    texts = [say(rng, rng.randint(1, 50)) for _ in range(40)] + [None, "", "é  x\n", "long " * 4000]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, "again", "c"), (None, "no id", "c")]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string, part string")
    segments = token_files.encode_documents(d, tokenizer_path()).cache()
    got = sorted(token_files.decode_documents(segments).collect(), key=lambda r: r.start)
    e, at = encoder(tokenizer_path()), 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
        ids = e.whole(t or "") + (2).to_bytes(4, "little")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    assert token_files.decode_documents(token_files.encode_documents(d.limit(0), tokenizer_path())).count() == 0


def test_packing_plan(spark):
    rng = random.Random(7)
    texts = [say(rng, rng.randint(1, 40)) for _ in range(80)] + [None, "", "word " * 700]
    d = table(spark, texts).union(table(spark, texts[:5])).withColumnRenamed("source", "length")
    got = best_fit.pack(d, tokenizer_path(), capacity=128).collect()
    e = encoder(tokenizer_path())
    whole = {i: np.frombuffer(e.whole(t or "") + b"\0\0\0\0", "<u4") for i, t in enumerate(texts)}
    assert sum(r.length for r in got) == sum(map(len, whole.values())) + sum(len(whole[i]) for i in range(5))
    for r in got:
        assert zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.1 * sum(r.length for r in got) / 128 + 2
    assert best_fit.pack(d.limit(0), tokenizer_path()).count() == 0


def two_languages(spark, n=60):
    rng = random.Random(1)
    a, b = [[x + y for x in s for y in t] for s, t in ((["ka", "lo", "mi"], ["n", "ra", "tu"]), (["sch", "ber", "ung"], ["en", "heit", "ich"]))]
    rows = [(i, " ".join(rng.choice((a, b)[i % 2]) for _ in range(rng.randint(5, 40))), ("aa", "bb")[i % 2], "s", 0) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "aa", "s", 0), (n + 1, "", None, "s", 0), (n + 2, "12 ?", "bb", "s", 0)], DOCS)


def test_language_accuracy(spark):
    d = two_languages(spark).withColumn("score", fold())
    contents = language.learn(d.where(fold() != 0))
    assert sorted(contents) == ["aa", "bb"]
    got = language.identify(d, contents).collect()
    assert all(r.lang_pred == r.lang and not r.rejected and 0 <= r.score <= 1 for r in got if r.doc_id < 60)
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got if r.doc_id >= 60)
    assert language.identify(d.limit(0), contents).count() == 0
    assert language.learn(d.limit(0)) == {} and {r.lang_pred for r in language.identify(d, {}).collect()} == {"und"}


def test_language_equals_brute_force(spark):
    import zstandard
    from pyspark.sql import functions as F

    d = two_languages(spark, 400).union(two_languages(spark, 40).where("doc_id < 30"))  # repeated rows, and ties in their hashes
    contents = language.learn(d, sample_docs=12, sample_chars=50)
    rows = d.where("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h")).collect()
    for lang in ("aa", "bb"):
        own = sorted((r.h, r.text[:50]) for r in rows if r.lang == lang)[:12]
        assert contents[lang] == " ".join(language.letters(t) for _, t in own).encode()
    long = d.limit(1).withColumn("text", F.lit("ka lo mi " * 50_000))
    for r in language.identify(d.union(long), contents).collect():
        raw = "".join(c if c.isalpha() else " " for c in (r.text or "").lower())
        raw = " ".join(raw.split()).encode()
        sizes = []
        for lang in ("aa", "bb") if raw else ():
            held = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append((len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False).compress(raw)), lang))
        sizes.sort()
        truth = (sizes[0][1], 1 - sizes[0][0] / sizes[1][0]) if raw else ("und", 0.0)
        assert (r.lang_pred, r.score) == (truth[0], pytest.approx(truth[1])) and r.rejected == (truth[1] < 0.003)


def test_lm_scores(spark):
    rng = random.Random(5)
    zipf = WORDS[:120] * 3 + WORDS[:10] * 60
    texts = [" ".join(rng.choice(zipf) for _ in range(rng.randint(1, 60))).upper() for _ in range(150)] + [None, "", "unseen wörds"]
    d = table(spark, texts)
    held = {r.doc_id: r.h for r in d.select("doc_id", (fold() == 1).alias("h")).collect()}
    from collections import Counter
    from math import log10

    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    c = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    for head in (100_000, 20):
        got = {r.doc_id: r for r in lm_score.score(d, head=head).collect()}
        for i, x in tokens.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(c[w] > 0 for w in x), n)
            assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
            assert r.score < 0
    assert lm_score.score(d.limit(0)).count() == 0
    assert lm_score.score(spark.createDataFrame([(2, "only held out")], "doc_id long, text string").where(fold() == 1)).count() <= 1


def test_lm_counts_above_the_head(spark):
    """More words than the head holds, each counted 10,000 times and more."""
    from collections import Counter
    from math import log10

    names = [f"w{i}" for i in range(70)]
    texts = [" ".join(names * 500)] * 40 + [" ".join(names[:3] * 400), "w0 w1 w69 unseen"]
    d = table(spark, texts)
    held = {r.doc_id: r.h for r in d.select("doc_id", (fold() == 1).alias("h")).collect()}
    c = Counter(w for i, x in enumerate(texts) if not held[i] for w in [*x.split(), None])
    n, v = sum(c.values()), len(c)
    assert min(c[w] for w in names) >= 10_000
    score = {}
    for head in (100_000, 10, 0):
        for r in lm_score.score(d, head=head).collect():
            x = [*texts[r.doc_id].split(), None]
            assert r.n_known == sum(c[w] > 0 for w in x)
            assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
            assert r.score == pytest.approx(score.setdefault(r.doc_id, r.score))


def test_lm_words_have_vectors_of_their_own(spark):
    """Two words of the same ending and count, neither among the most frequent, each follow a word of their own."""
    names = [f"n{i}" for i in range(80)]
    train = [f"{' '.join(names)} left lokyy {' '.join(names)} right mirzyy {' '.join(names)}"] * 60
    held = ["left lokyy", "left mirzyy", "right mirzyy", "right lokyy"]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:60] + [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    d = spark.createDataFrame(list(zip(ids, train + held, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(d).collect()}
    a, b, c, e = (got[i] for i in ids[-4:])
    assert a > b + 1 and c > e + 1


def test_quality_rules(spark):
    rng = random.Random(6)
    good = [". ".join(say(rng, 12) for _ in range(4)) for _ in range(60)]
    junk = ["\n".join(" ".join(f"{w}###" for w in say(rng, 12).split()) for _ in range(4)) for _ in range(60)]
    d = table(spark, good + junk + [None, "", "short text", good[0]])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.apply(d, quality.learn(d, labels)).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 120))
    assert [got[i].base_failed for i in (120, 121, 122, 123)] == [True, True, True, False]
    plain = {r.doc_id: r.kept for r in quality.apply(d, quality.learn(d, labels.limit(0))).collect()}
    assert plain[61] and not plain[120]
    assert quality.apply(d.limit(0), quality.learn(d, labels)).count() == 0


def test_html_table(spark):
    d = spark.createDataFrame([(1, "u", "<article><h1>Head</h1><p>Some text of the article, long enough.</p></article><footer>No</footer>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(d).collect()}
    text = "Head Some text of the article, long enough."
    assert got == {1: ("u", text, len(text)), None: (None, "", 0)}
    assert html_text.extract(d.limit(0)).count() == 0


CALLS = "conv_id string, call_id string, turn int, name string, arguments string, after array<string>"


def test_tool_calls(spark):
    import json

    calls = spark.createDataFrame(
        [
            ("c", "a", 1, "f", '{"x":1,"y":{"b":2,"a":[1,2.5]}}', []), ("c", "b", 2, "f", '{"x":"s"}', ["a"]), ("c", "d", 3, "f", "nope", ["zz"]), ("c", "e", 4, "g", "{}", ["e"]), ("c", "h", 5, "f", None, None),
            ("c", "i", 6, "f", '{"x":2}', ["i2"]), ("c", "i2", 7, "f", '{"x":2}', ["i"]), ("c", "k", 8, "f", '{"x":3,"q":1}', ["a", "b", "l"]), ("c", "l", 9, "f", '{"x":4}', ["b", "b"]), ("c", "l", 9, "f", '{"x":4}', ["b", "b"]), (None, "a", 1, "f", "{}", []), ("o", "a", 3, "f", "{}", []), ("o", "b", 5, "f", "{}", ["a", "q"]),
        ],
        CALLS,
    )
    results = spark.createDataFrame([("c", "a", 'ok "q"\n\u000bé'), ("c", "l", None), ("c", "zz", "orphan"), ("c", None, "x")], "conv_id string, call_id string, content string")
    schemas = [("f", [("x", "integer", True), ("y", "object", False)])]
    got = {r.call_id: r for r in tool_calls.link(calls, results, schemas).collect() if r.conv_id == "c"}
    assert sorted((r.call_id, r.level) for r in tool_calls.link(calls, results, schemas).collect() if r.conv_id == "o") == [("a", 0), ("b", 1)]
    assert {i: (r.status, r.level, r.problems, r.copies) for i, r in got.items()} == {
        "a": ("linked", 0, "", 1), "b": ("invalid", 1, "not integer x", 1), "d": ("bad arguments", 0, "", 1), "e": ("invalid", None, "unknown tool", 1), "h": ("bad arguments", 0, "", 1),
        "i": ("cycle", None, "", 1), "i2": ("cycle", None, "", 1), "k": ("invalid", 3, "unknown q", 1), "l": ("linked", 2, "", 2), "zz": ("no call", None, "", 0),
    }
    for r in got.values():
        o = json.loads(r.json)
        assert list(o) == sorted(o) and " " not in re.sub(r'"(\\.|[^"])*"', "", r.json)
    assert json.loads(got["a"].json)["result"] == 'ok "q"\n\u000bé' and '{"a":[1,2.5],"b":2}' in got["a"].json
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_topological_levels(spark):
    rng = random.Random(11)
    rows, truth = [], {}
    for conv in range(12):
        n = 70 if conv == 0 else rng.randint(1, 25)
        after = {i: [i + 1] if conv == 0 else [rng.randrange(n) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] for i in range(n)}
        if conv % 2:
            after = {i: [j for j in js if j < i] for i, js in after.items()}
        levels = {}
        for _ in range(n + 1):  # Kahn
            levels |= {i: max((levels[j] + 1 for j in js if j in after), default=0) for i, js in after.items() if i not in levels and all(j in levels for j in js if j in after)}
        truth |= {(str(conv), str(i)): levels.get(i) for i in after}
        rows += [(str(conv), str(i), i, "f", "{}", [str(j) for j in js]) for i, js in after.items()]
    calls = spark.createDataFrame(rows, CALLS)
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(calls, work_dir(spark, "t")).collect()}
    assert {k: got.get(k) for k in truth} == truth and got.keys() <= truth.keys() and None in truth.values() and got["0", "0"] == 69


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    texts = [say(rng, 60) for _ in range(30)]
    item = say(rng, 30)
    texts += [edited(rng, texts[0], 1), texts[1], f"{say(rng, 20)} {item} {say(rng, 20)}", f"{say(rng, 20)} call +1 (212) 555-1234 {say(rng, 20)}"]
    docs = table(spark, texts).unionByName(two_languages(spark).where("doc_id >= 60").selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars"))
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "pii", "best_fit_packing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf).cache()
        assert left.columns == docs.columns, name
    got = {r.doc_id: r for r in left.collect()}
    assert set(got) == {*range(30), 33}
    assert "555-1234" not in got[33].text and got[33].n_chars == len(got[33].text) and all(got[i].text == texts[i] for i in range(30))
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    table_name = {"op3_tool_call_linking": "conversations", "op8_html_extraction": "pages"}.get(name, "documents")
    sf = "/root/testdata/sf0.001"
    n = QUERIES[name](spark, sf).count()
    whole = spark.read.parquet(f"{sf}/{table_name}.parquet").count()
    assert n >= (1 if name in ("op3_tool_call_linking", "op9_decontamination") else whole)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    cursor = con.execute(SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in cursor.fetchall())


def test_lm_training_draws_every_run_of_a_large_corpus(spark):
    """At 400 million training tokens as at 4 million a task draws each of its runs: a draw is used among the groups, and among the units of a group of several."""
    d = spark.createDataFrame([(i, np.arange(201, dtype=np.uint16).tobytes()) for i in range(40)], "doc_id long, units binary")
    size = 256  # 64 groups of one unit, 64 of three
    unigram = np.full(size, 1 / size)
    for n_all in (4_000_000, 400_000_000):
        m = lm_score.fit(d, lm_score.LogBilinear(unigram), unigram, n_all)
        assert m.used[-1] >= 40 * (201 + 137)
