"""Mixing, sharding and host quality, which run on column expressions alone."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from albumetry.llm import mixing, oracles, quality, sharding
from tests.llm.helpers import ODD, documents, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rows = [(d, t, "en", None if d == 900 else "b") for d, t in ODD]
    rng = random.Random(2)
    for k in range(300):
        source = "a" if k % 3 == 0 else rng.choice(["b", "c", "é", "Z", None])
        rows.append((k, text_of(k, rng.randrange(0, 90), 30), "en", source))
    rows += [(610 + k, text_of(1, 20), "en", "tiny") for k in range(3)] + [(600, "", "en", "empty")]
    rows += [(700, "same line\nsame line\n\n#x $y\nother", "en", "b"), (701, text_of(4, 9000), "en", "c"), (702, text_of(4, 9), "en", "w")]
    rows += [(620, text_of(5, 33, 30), "en", "b")] * 2
    return rows


def targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing out step by step: what passes a cap goes round again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in order if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * x / sum(rest.values()) for s, x in rest.items()}
        over = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**fixed, **share}
        fixed.update(over)


def test_mix(spark):
    rows = corpus()
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    per, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, _, _, s in rows:
        per[s] += size[d]
        largest[s] = max(largest[s], size[d])
    want = targets(per)
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per[r["source"]])
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 3
        taken[r["source"]] += r["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= max(largest[s], 99), s
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(docs.filter("false")).count() == 0


def test_mixed_documents(spark):
    rows = corpus()
    docs = documents(spark, rows)
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r["doc_id"]] += r["times"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +times


def test_mix_of_repeated_ids(spark):
    """A source whose rows share two ids still comes near its target."""
    rows = [(k % 2, text_of(k, 100), "en", "a") for k in range(400)] + [(5, text_of(1000 + k, 20), "en", "b") for k in range(600)]
    taken, target = Counter(), {}
    for r in mixing.mix(documents(spark, rows)).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 100 for s in target)


def test_shards_of_one_id(spark):
    load = Counter()
    for r in sharding.shard(documents(spark, [(7, "equal texts of one id " * 10)] * 800 + [(7, text_of(k, 40)) for k in range(400)])).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) < 1.3 * min(load.values())


def test_larger_budgets_take_supersets(spark):
    sized = mixing.sizes(documents(spark, corpus())).cache()
    goal = mixing.targets(sized).cache()
    taken = []
    for part in (0.2, 0.5, 0.9):
        cuts = mixing.thresholds(sized, goal.withColumn("target", goal["source_size"] * part)).collect()
        taken.append({r["source"]: r["cut"] for r in cuts})
    assert all(a[s] <= b[s] for a, b in zip(taken, taken[1:]) for s in a)


@pytest.mark.parametrize("bundles", [16, 4096])
def test_shards(spark, bundles):
    rows = corpus() + [(2000 + k, "hot text " * 20, "en", "a") for k in range(200)]
    docs = documents(spark, rows)
    got = sharding.shard(docs, bundles=bundles).collect()
    by = defaultdict(list)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    assert sharding.shard(docs.filter("false")).count() == 0


def test_placing_equals_a_plain_loop():
    """Heaviest first, each to the shard where the dot product with what is left of its capacity is highest, the first of equal ones."""
    import numpy as np

    rng = random.Random(4)
    for shards in (1, 3, 8):
        loads = [[rng.randrange(1, 1000), rng.randrange(1, 300), rng.randrange(1, 9)] for _ in range(60)]
        total = [sum(x) for x in zip(*loads)]
        share = [[a / b for a, b in zip(x, total)] for x in loads]
        left = [[1 / shards] * 3 for _ in range(shards)]
        want = [None] * len(loads)
        for i in sorted(range(len(loads)), key=lambda i: (-sum(share[i]), i)):
            dots = [sum(a * b for a, b in zip(c, share[i])) for c in left]
            best = max(range(shards), key=lambda k: (round(dots[k], 12), -k))
            want[i] = best
            left[best] = [a - b for a, b in zip(left[best], share[i])]
        assert sharding.place_bundles(np.array(loads, dtype=float), shards).tolist() == want
    assert sharding.place_bundles(np.zeros((0, 3)), 4).tolist() == []
    assert sharding.place_bundles(np.zeros((5, 3)), 4).tolist() == [0] * 5


def test_shards_are_even_without_giants(spark):
    rows = [(k, text_of(k, 20 + k % 50)) for k in range(1500)] + [(5000 + k, "hot text " * 30) for k in range(750)]
    load = Counter()
    for r in sharding.shard(documents(spark, rows)).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.03 * min(load.values())


def test_equal_texts_share_a_shard(spark):
    rows = [(k, text_of(k, 20 + k % 50)) for k in range(400)]
    rows += [(1000 + 10 * g + k, text_of(9000 + g, 300)) for g in range(40) for k in range(2 + g % 2)]
    rows += [(3000 + k, None if k % 2 else "") for k in range(300)]  # over a third of the rows, hardly any bytes
    shards, empty, load = defaultdict(set), Counter(), Counter()
    text = dict(rows)
    for r in sharding.shard(documents(spark, rows)).collect():
        t = text[r["doc_id"]] or ""
        shards[t].add(r["shard"])
        empty[r["shard"]] += t == ""
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for t, s in shards.items() if t)
    assert len(shards[""]) == 8 and max(empty.values()) < 100
    assert max(load.values()) < 1.15 * min(load.values())


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def shrunk(failed, docs):
    """Rates by a beta prior whose strength follows from the spread between hosts beyond counting noise."""
    total = sum(docs.values())
    m = sum(failed.values()) / total
    if not 0 < m < 1 or total == len(docs):
        return dict.fromkeys(docs, m)
    spread = sum(n * (failed[h] / n - m) ** 2 for h, n in docs.items())
    rho = min(1, max(0, (spread / (m * (1 - m)) - len(docs)) / (total - len(docs))))
    s = 1 / rho - 1 if rho else None
    return {h: m if s is None else (failed[h] + s * m) / (n + s) for h, n in docs.items()}


def test_hosts_of_one_document_share_the_mean(spark):
    """One document tells nothing of its host: 300 hosts of one document get the corpus rate, beside two hosts that differ too."""
    rows = [(k, text_of(k, 60 if k % 3 else 5), "en", f"h{k}") for k in range(300)]
    got = quality.judge(documents(spark, rows)).collect()
    assert {round(r["host_rate"], 9) for r in got} == {round(1 / 3, 9)} and all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
    rows += [(1000 + k, text_of(k, 5 if k % 10 else 60), "en", "bad") for k in range(100)] + [(2000 + k, text_of(k, 60), "en", "good") for k in range(100)]
    rate = {r["host"]: r["host_rate"] for r in quality.judge(documents(spark, rows)).collect()}
    assert rate["bad"] > 0.8 and rate["good"] < 0.1 and 0 < rate["h1"] < rate["h0"] < 1


def test_quality(spark):
    rows = corpus() + [(800, "a b c a b c a b c d", "en", "b"), (801, "x " * 60, "en", "b"), (802, "a b c", "en", "b"), (803, "a a a a", "en", "b"),
                       (804, "line\n" * 70 + "\x0b\n \n é 🎉#", "en", "b")]
    docs = documents(spark, rows)
    got = quality.judge(docs, host="source").collect()
    want = {r[0]: measures(r[1]) for r in rows}
    broken, docs_of = defaultdict(Counter), Counter()
    for r in got:
        n, chars, symbols, lines, repeated = m = want[r["doc_id"]]
        assert tuple(r)[1:6] == m, r
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        docs_of[r["host"]] += 1
        for rule, x in {"few": n < 50, "rep": 100 * repeated > 50 * n, "sym": 10 * symbols > n, "lines": 10 * lines > n,
                        "length": chars < 2 * n or chars > 15 * n}.items():
            broken[rule][r["host"]] += x
    rates = [shrunk(broken[rule], docs_of) for rule in broken]
    for r in got:
        rate = max(x[r["host"]] for x in rates)
        assert r["host_rate"] == pytest.approx(rate)
        assert r["kept"] == (not r["base_failed"] and rate <= 0.5)
    assert len(got) == len(rows)
    assert quality.judge(docs.filter("false")).count() == 0


def test_equal_hosts_share_the_mean(spark):
    rows = [(k, text_of(k, 60 if k % 2 else 5), "en", "xy"[k // 2 % 2]) for k in range(8)]
    assert {r["host_rate"] for r in quality.judge(documents(spark, rows)).collect()} == {0.5}


def test_sql_twins_parse():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.execute("create table embeddings(vec_id bigint, embedding float[], label int)")
    for sql in (oracles.MIXING, oracles.QUALITY, oracles.URLS, oracles.TOP_K):
        assert con.execute(sql).fetchall() == []
