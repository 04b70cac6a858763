"""Property tests: rule columns equal plain-Python statements of the rules on
random batches (one Spark job per batch)."""


from hypothesis import given, settings
from hypothesis import strategies as st

from edspark import schemas as S
from edspark.functions import rules as R
from edspark.functions import text as X
from edspark.functions import vitals as V

vals = st.one_of(st.none(), st.floats(min_value=-500, max_value=500, allow_nan=False), st.sampled_from([0.0, -0.0]))


def sanitize_py(key, v):
    if v is None or v < 0 or (v == 0 and key in S.ZERO_IS_MISSING):
        return S.MEDIAN_VITALS[key]
    lo, hi = S.VALID_RANGES[key]
    return max(lo, min(hi, v))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sorted(S.MEDIAN_VITALS)), vals), min_size=1, max_size=60))
def test_sanitize_value_property(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    out = []
    for key in sorted({k for k, _ in rows}):
        sub = df.filter(df.k == key).select(V.sanitize_value("v", key).alias("s"), "v").collect()
        out += [(key, r.v, r.s) for r in sub]
    for key, v, s in out:
        assert s == sanitize_py(key, v), (key, v, s)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(vals, vals), min_size=1, max_size=60))
def test_first_truthy_property(spark, rows):
    got = spark.createDataFrame(rows, "a double, b double").select(V.first_truthy("a", "b")).collect()
    for (a, b), r in zip(rows, got):
        assert r[0] == (a or b)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=" 0123456789-a.\t", max_size=6), min_size=1, max_size=60))
def test_clean_num_property(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(X.clean_num("s")).collect()
    for t, r in zip(texts, got):
        s = t.strip()
        want = float(s) if s and s.isdigit() and not s.startswith("-") else None
        assert r[0] == want, (t, r[0])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10 ** 7), min_size=1, max_size=40))
def test_zero_pad_property(spark, nums):
    got = spark.createDataFrame([(n,) for n in nums], "n long").select(R.zero_pad("n", 4)).collect()
    assert [r[0] for r in got] == [f"{n:04d}" for n in nums]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.floats(min_value=0, max_value=1), st.integers(1, 5), st.integers(0, 4)),
                min_size=1, max_size=60))
def test_route_property(spark, rows):
    got = spark.createDataFrame(rows, "c double, lvl int, pol int").select(R.route_action("c", "lvl", "pol")).collect()
    for (c, lvl, pol), r in zip(rows, got):
        want = pol if (c < 0.6 or lvl == 3) else {1: 3, 2: 2, 3: 2, 4: 1, 5: 1}[lvl]
        assert r[0] == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.floats(min_value=1, max_value=300), st.floats(min_value=1, max_value=300)),
                min_size=1, max_size=60))
def test_shock_index_rounding_property(spark, rows):
    got = spark.createDataFrame(rows, "h double, s double").select(V.shock_index("h", "s", 2)).collect()
    for (h, s), r in zip(rows, got):
        assert r[0] == round(h / s, 2)
