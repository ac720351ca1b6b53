import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from albumetry.llm import suffixes
from tests.llm.helpers import ODD, documents, text_of


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        left = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    return sorted(out, key=repr)


def corpus(size):
    rng = random.Random(3)
    shared = [text_of(k, size) for k in range(4)]
    rows = list(ODD) + [(1, text_of(50, 3 * size)), (2, text_of(50, 3 * size))]  # equal texts
    for k in range(40):
        parts = [text_of(1000 + k, rng.randrange(5, size))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a: a + rng.randrange(len(p) // 2, len(p))], text_of(2000 + 7 * k, rng.randrange(1, 9))]
        rows.append((10 + k, "é".join(parts)))
    rows += [(200, "a" * (9 * size)), (201, "ab" * (5 * size)), (202, shared[0] + " x " + shared[0])]
    return rows


def got(spark, rows, **kw):
    return sorted(map(tuple, suffixes.removed(documents(spark, rows), **kw).collect()), key=repr)


def test_default_lengths(spark):
    rows = corpus(120)
    assert got(spark, rows) == brute(rows, 400)


@pytest.mark.parametrize("small, part", [(512, 1 << 21), (2, 150)])
def test_short_strings_large_buckets_and_cut_texts(spark, monkeypatch, small, part):
    monkeypatch.setattr(suffixes, "SMALL", small)
    monkeypatch.setattr(suffixes.parts_of, "__defaults__", (part,))
    rows = corpus(25)
    assert got(spark, rows, length=60, gram=20) == brute(rows, 60)


def test_repeated_rows_and_empty_table(spark):
    t = text_of(1, 200)
    rows = [(1, t), (1, t), (2, t + "x"), (3, None)]
    assert got(spark, rows) == brute(rows, 400)
    assert suffixes.removed(documents(spark, rows).filter("false")).count() == 0


def test_documents_without_repeats(spark):
    p = text_of(8, 120)
    rows = [(1, "début " + p + " fin"), (2, p + " only here"), (3, "untouched"), (4, None)]
    docs = documents(spark, rows)
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert found == {1: ("début fin", 9), 2: ("only here", 9), 3: ("untouched", 9), 4: (None, None)} or found[3] == ("untouched", 9)
    assert found[1][0].startswith("début") and p not in found[1][0] and found[1][1] == len(found[1][0])


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 57)
    for w in (1, 2, 7, 57, 58):
        assert suffixes.sliding_min(x, w).tolist() == [x[i:i + w].min() for i in range(57 - w + 1)]


@pytest.mark.parametrize("small, part", [(512, 1 << 21), (2, 150)])
def test_words_large_buckets_and_cut_texts(spark, monkeypatch, small, part):
    from tests.llm.test_pipeline import words_left

    monkeypatch.setattr(suffixes, "SMALL", small)
    monkeypatch.setattr(suffixes.parts_of, "__defaults__", (part,))
    rows = corpus(90) + [(300, " ".join("ab"[k * k % 7 % 2] for k in range(900)))]
    left = suffixes.without_repeats(documents(spark, rows), length=40, gram=8, unit=suffixes.WORDS)
    key = lambda r: (str(r[0]), r[1])
    got = sorted(((r["doc_id"], " ".join((r["text"] or "").split())) for r in left.collect() if r["doc_id"] != 905), key=key)
    assert got == sorted(((d, " ".join(w)) for d, w, _ in words_left(rows, 40) if d != 905), key=key)
    assert any(n for _, _, n in words_left(rows, 40))


def test_suffixes_of_one_crowded_bucket_are_dealt_out(spark, monkeypatch):
    """The open suffixes of one q-gram reach many tasks, also where the planner splits nothing."""
    from pyspark.sql import functions as F

    common = text_of(5, 64)  # under 400 bytes, so that every window around it is one of its own document
    rows = [(k, text_of(10_000 + k, 40, 10**9) + common + text_of(50_000 + k, 40, 10**9)) for k in range(6_000)]
    seen, written = [], suffixes.written

    def spied(df):
        if {"final", "many"} <= set(df.columns) and "units" not in df.columns:
            seen.append(sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()))
        return written(df)

    monkeypatch.setattr(suffixes, "written", spied)
    monkeypatch.setattr(suffixes, "SMALL", 1 << 20)  # the levels of large buckets are tested above
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        spans, copies = suffixes.repeated_spans(documents(spark, rows))
        assert spans.count() == 0 and copies.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    [sizes] = seen
    assert sum(sizes) > 5_000 and sizes[-1] < sum(sizes) / 2


def shuffled(spark, run):
    """(most rows that a task reads, all rows) of every stage of ``run`` that reads a shuffle."""
    jsc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway
    jsc.listenerBus().waitUntilEmpty()
    store, none = jsc.statusStore(), gateway.new_array(gateway.jvm.double, 0)

    def stages():
        listed = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s for s in (listed.apply(k) for k in range(listed.size()))}

    before = set(stages())
    run()
    jsc.listenerBus().waitUntilEmpty()
    out = []
    for (number, attempt), stage in stages().items():
        if (number, attempt) in before or stage.shuffleReadRecords() == 0:
            continue
        tasks = store.taskList(number, attempt, 10_000)
        rows = [tasks.apply(k).taskMetrics().get().shuffleReadMetrics().recordsRead() for k in range(tasks.size())]
        out.append((max(rows), sum(rows)))
    return out


def shuffled_unplanned(spark, docs, **kw):
    """``shuffled`` for the spans, where the planner splits and broadcasts nothing by itself; and the spans."""
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before, out = {k: spark.conf.get(k) for k in fixed}, []
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        sizes = shuffled(spark, lambda: out.extend(map(set, (map(tuple, df.collect()) for df in suffixes.repeated_spans(docs, **kw)))))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return sizes, *out


def test_copies_of_one_text_are_dealt_out(spark):
    rows = [(k, text_of(1, 120)) for k in range(8_000)] + [(10_000 + k, text_of(100 + k, 5, 10**9)) for k in range(500)]
    sizes, spans, copies = shuffled_unplanned(spark, documents(spark, rows))
    assert {d for d, _ in copies} == set(range(8_000))
    large = [(most, total) for most, total in sizes if total > 8_000]
    assert large and all(most < total / 2 for most, total in large)


def test_cells_of_one_large_bucket_are_dealt_out(spark, monkeypatch):
    """Suffixes that share a core, or whose text ends within the cell so that they have no extent, reach many tasks."""
    monkeypatch.setattr(suffixes, "SMALL", 64)
    common = text_of(5, 30) + " "
    rows = [(k, f"{k:04d}" + common + text_of(10_000 + k, 9, 10**9)) for k in range(4_000)]
    sizes, spans, copies = shuffled_unplanned(spark, documents(spark, rows), length=60, gram=20)
    gone = {}
    for doc, _, start, end in spans:
        gone.setdefault(doc, set()).update(range(start, end))
    assert not copies and len(gone) == 4_000 and all(set(range(4, 4 + len(common))) <= g for g in gone.values())
    large = [(most, total) for most, total in sizes if total > 8_000]
    assert large and all(most < total / 4 for most, total in large)
