import math
from collections import Counter

import pytest

from lumenquote.llm import mixing as X

SIZES = {"a": 3000, "b": 800, "c": 100}


@pytest.fixture(scope="module")
def tokens(spark):
    rows, k = [], 0
    for source, n in SIZES.items():
        for i in range(n):
            rows.append((k, source, 20 + (i * 37) % 160))
            k += 1
    rows += [(k + i, None, 100) for i in range(300)] + [(k + 300, "a", 0), (k + 301, "elsewhere", 5000)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("ghost", 0.1, 2), (None, 0.1, 1), ("a", None, 1), ("z", 0.0, 1)], "source string, target_share double, max_repeats int")


def test_shares_repeats_and_caps(spark, tokens, targets):
    rule = X.MixRule(block_tokens=512, bucket_docs=100)
    mixed = X.mix(tokens, targets, rule).collect()
    total = tokens.agg({"n_tokens": "sum"}).first()[0]
    by = Counter()
    for r in mixed:
        by[r.source] += r.n_tokens
    plan, whole = X.plan_shares(tokens, targets)
    shares = plan.collect()
    assert whole == total
    for s in shares:
        assert abs(by[s.source] - s.aim) <= 180, s
    assert by["c"] == 2 * next(s.available for s in shares if s.source == "c") and by["ghost"] == 0
    uses = Counter(r.doc_id for r in mixed)
    assert max(uses[r.doc_id] for r in mixed if r.source == "a") == 1 and max(uses.values()) <= 3
    assert len({(r.doc_id, r.copy) for r in mixed}) == len(mixed)
    report = {r.source: r for r in X.report_shares(tokens, targets, rule).collect()}
    assert report["ghost"].mixed_tokens == 0 and report["a"].share_of_aim == pytest.approx(0.5, abs=0.01) and sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_every_stretch_is_mixed(tokens, targets):
    rule = X.MixRule(block_tokens=512, bucket_docs=100)
    mixed = sorted(X.mix(tokens, targets, rule).collect(), key=lambda r: (r.slot, r.ord))
    all_tokens = sum(r.n_tokens for r in mixed)
    share = sum(r.n_tokens for r in mixed if r.source == "a") / all_tokens
    done = a = 0
    for r in mixed:
        done += r.n_tokens
        a += r.n_tokens * (r.source == "a")
        assert abs(a - share * done) < 6 * 512


def plan_of(spark, aims):
    return spark.createDataFrame(list(aims.items()), "source string, aim double")


def test_slots_are_ranked_without_gaps(spark):
    slots, n = X.schedule(plan_of(spark, {"p": 70_000.0 * 4096, "q": 30_000.0 * 4096, "none": 0.0}))
    got = slots.groupBy("source").agg({"rank": "max", "slot": "count"}).collect()
    assert {r.source: r["max(rank)"] + 1 for r in got} == {r.source: r["count(slot)"] for r in got} and sum(r["count(slot)"] for r in got) == n
    assert {r.source for r in got} == {"p", "q"} and all(r["count(slot)"] >= {"p": 70_000, "q": 30_000}[r.source] for r in got)


def test_many_targets(spark):
    """More sources than cells of the least number; each gets its slots."""
    aims = {f"s{i}": 4096.0 * (1 + i % 5) for i in range(12_000)}
    slots, n = X.schedule(plan_of(spark, aims))
    got = {r.source: r["count"] for r in slots.groupBy("source").count().collect()}
    assert sum(got.values()) == n and all(got.get(k, 0) >= v // 4096 for k, v in aims.items())


def test_golden_points_keep_precision(spark):
    got = spark.range(10**9, 10**9 + 2000).select(X.golden_point(X.F.col("id")).alias("x")).collect()
    x = sorted(r.x for r in got)
    gaps = [b - a for a, b in zip(x, x[1:])]
    assert max(gaps) < 3 / 2000 and min(gaps) > 0.1 / 2000 and not math.isnan(sum(gaps))


def test_nothing_to_mix(spark, tokens, targets):
    assert X.mix(tokens.limit(0), targets).count() == 0 and X.mix(tokens, targets.limit(0)).count() == 0
    assert X.report_shares(tokens.limit(0), targets).count() == 4


def test_document_tokens(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9), (1, "a b", "s", 9), (2, None, None, 9), (3, "", "s", 9)], "doc_id bigint, text string, source string, n_tokens int")
    assert {tuple(r) for r in X.document_tokens(docs).collect()} == {(1, "s", 2), (2, None, 0), (3, "s", 0)}
