"""Every registered query of the engine's own operators against its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tallyweave import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if Path(path).is_dir() else path}')")
    return con


def shown(value):
    if value is None or value != value:
        return "NULL"
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(shown(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def whole_partition(got, duck, part):
    """Every conversation once, places gapless within a part."""
    ids = [r[0] for r in duck.execute("select distinct conv_id from conversations").fetchall()]
    assert sorted(r["row_id"] for r in got) == sorted(ids)
    places = {}
    for r in got:
        places.setdefault(r[part], []).append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return places


def hold_balanced(got, duck):
    assert set(whole_partition(got, duck, "part")) == set(range(8))
    sums = [sum(r["seqlen"] for r in got if r["part"] == p) for p in range(8)]
    assert max(sums) - min(sums) <= max(r["seqlen"] for r in got)


def hold_micro(got, duck):
    places = whole_partition(got, duck, "micro")
    assert len(places) % 2 == 0
    budget = max(20_000, max(r["seqlen"] for r in got))
    assert len(places) <= -(-sum(r["seqlen"] for r in got) // budget) + 2


def hold_report(got, duck):
    (r,) = got
    total = duck.execute("select sum(length(text)) from conversations").fetchone()[0]
    assert r["after_max"] - r["after_min"] <= r["before_max"] - r["before_min"] and abs(8 * r["after_mean"] - total) < 1e-6


def hold_resample(got, duck):
    scores = {i: s for i, s in duck.execute("select l_orderkey, sum(l_discount) from lineitem group by 1").fetchall()}
    assert len(got) == len(scores) and sorted(r["draw"] for r in got) == list(range(len(got)))
    drawn = sum(r["score"] for r in got) / len(got)
    want = sum(s**3 for s in scores.values()) / sum(s**2 for s in scores.values())
    assert abs(drawn - want) < 0.1 * want and all(abs(scores[r["row_id"]] - r["score"]) < 1e-6 for r in got)


def hold_shuffled(got, duck):
    n = duck.execute("select count(*) from documents").fetchone()[0]
    for epoch in (0, 1):
        own = [r for r in got if r["epoch"] == epoch]
        assert sorted(r["row_id"] for r in own) == list(range(n))
        sizes = Counter(r["batch"] for r in own)
        assert set(sizes.values()) == {20} and set(sizes) == set(range(n // 20))
    assert [r["row_id"] for r in sorted(got, key=lambda r: (r["epoch"], r["batch"]))] != list(range(n)) * 2


def hold_seeded(got, duck):
    ids = [r[0] for r in duck.execute("select doc_id from documents order by doc_id").fetchall()]
    picked = np.random.default_rng(1).choice(len(ids), size=25, replace=False)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["row_id"])] == [ids[i] for i in picked]


def hold_generations(got, duck):
    rows = [r[0] for r in duck.execute("select item_id from benchmark order by text").fetchall()]
    order = np.random.RandomState(42).permutation(len(rows))[:10]
    assert [r["item_id"] for r in sorted(got, key=lambda r: r["row_id"])] == [rows[i] for i in order]


def hold_holdout(got, duck):
    ids = {r[0] for r in duck.execute("select doc_id from documents").fetchall()}
    own = [r["doc_id"] for r in got]
    assert len(set(own)) == len(own) and set(own) <= ids and 0.03 * len(ids) < len(own) < 0.2 * len(ids)


def hold_path(got, duck):
    for name in {r["name"] for r in got}:
        values = [v[0] for v in duck.execute("select value from events where value is not null and event_type = ? order by event_id", [name]).fetchall()]
        b, path = 0.2, {r["step"]: r["coefficient"] for r in got if r["name"] == name}
        assert len(path) == len(values)
        for step, v in enumerate(values, 1):
            b *= 1 + min(max(v / 10 - 1, -0.2), 0.2) * 64 / 1000
            assert abs(path[step] - b) < 1e-6 + 1e-9 * b


def hold_languages(got, duck):
    n = duck.execute("select count(*) from documents").fetchone()[0]
    assert len(got) == n and all(r["held_out"] == (r["doc_id"] % 4 == 0) for r in got)
    told = [r for r in got if r["held_out"] and r["told"] is not None]
    assert sum(r["told"] == r["lang"] for r in told) >= 0.9 * len(told) and all(r["english"] == (r["told"] in ("en", None)) for r in got)


def hold_sentences(got, duck):
    want = dict(duck.execute(r"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda a: trim(a, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) from documents").fetchall())
    assert {r["doc_id"]: r["plain"] for r in got} == want and all((r["plain"] > 0) == (r["learned"] > 0) for r in got)
    assert sum(r["learned"] for r in got) >= 0.8 * sum(r["plain"] for r in got)


def hold_rollup(got, duck):
    """Means over prompts against SQL; the bootstrapped metrics are held against numpy in test_operators."""
    known = {(r["data_source"], r["metric"]): r["value"] for r in got if r["metric"].startswith("mean@")}
    assert known and {r["variable"] for r in got} >= {"score"}
    want = duck.execute(SQL["eval_mean_std"]).fetchall()
    for source, n, mean, _ in want:
        assert abs(known[source, f"mean@{n}"] - mean) < 2e-6


HOLDS = {
    "balanced_parts": hold_balanced,
    "balance_report": hold_report,
    "micro_batches": hold_micro,
    "resample_by_score": hold_resample,
    "verb_batches_shuffled": hold_shuffled,
    "sample_seeded": hold_seeded,
    "sink_sample_generations": hold_generations,
    "preprocess_holdout": hold_holdout,
    "adaptive_kl_path_all": hold_path,
    "languages_told": hold_languages,
    "sentence_bounds": hold_sentences,
    "eval_rollup_bootstrap": hold_rollup,
}


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_query_without_sql(spark, sf, duck, name):
    HOLDS[name](QUERIES[name](spark, sf).collect(), duck)


def test_clipped_covariance_query(spark, sf):
    """A thousandth of the tokens go at most, so the loss stays near that without clipping by covariance."""
    r = QUERIES["loss_clip_cov"](spark, sf).first().asDict()
    assert all(v is not None and v == v for v in r.values()) and abs(r["loss"]) < 10


def test_every_query_without_sql_is_held():
    assert set(QUERIES) - set(SQL) == {*HOLDS, "loss_clip_cov"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 100


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(registry.queries()) <= set(__spark_entry__.queries())

