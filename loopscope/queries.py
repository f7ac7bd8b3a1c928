"""The catalogue: every operator over the sample tables, with the SQL that says the same.

``events`` stands for a trace: the user is the rank, the event's type the path, its time the
instant, in microseconds, and its value a counter. Doubles are rounded to 4 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopscope.functions import paths, scalars
from loopscope.operators import alias, clustering, flow, loopstats, nesting, occurrences, phases, ranks, reduction

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Instants of events as SQL.
_T = "epoch_us(ts)"
_EV = f"ev AS (SELECT user_id AS rank, event_type AS path, {_T} AS t, event_id AS seq, value, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
_RED = f"""{_EV}, gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY rank, path ORDER BY t, seq) AS gap FROM ev),
total AS (SELECT max(t) - min(t) AS total FROM ev),
reduced AS (SELECT rank, path, count(*) AS n, min(t) AS t_first, max(t) AS t_last, CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END AS gap_mean, CASE WHEN count(*) > 1 THEN median(gap) END AS gap_median FROM gaps GROUP BY rank, path),
shared AS (SELECT *, n * gap_mean / total AS share FROM reduced, total)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as occurrences: rank, path, t, seq, value, cents, k."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("rank"), F.col("event_type").alias("path"), micros("ts").alias("t"), F.col("event_id").alias("seq"), "value", F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def _reduced(spark: SparkSession, sf_dir: str, medians: bool = False) -> DataFrame:
    return reduction.reduce_paths(trace(spark, sf_dir), ["rank", "path"], "t", medians=medians)


def _shared(spark: SparkSession, sf_dir: str, medians: bool = False) -> DataFrame:
    return reduction.explained_share(_reduced(spark, sf_dir, medians), reduction.total_time(trace(spark, sf_dir), "t"))


def r4(c: str, name: str | None = None) -> Column:
    return F.round(c, 4).alias(name or c)


# Reduction and filters


@query(f"""WITH {_RED}
SELECT g.rank, g.path, count(*) AS n, min(t) AS t_first, max(t) AS t_last, round(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END, 4) AS gap_mean,
 round(CASE WHEN count(*) > 1 THEN median(gap) END, 4) AS gap_median, round(CASE WHEN count(*) > 1 THEN avg(cents) END, 4) AS cents_mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(cents) END, 4) AS cents_stdev,
 CAST(CASE WHEN count(*) > 1 THEN sum(cents) END AS BIGINT) AS cents_sum, round(CASE WHEN count(*) > 1 THEN sum(cents) END / 1e6 * 100, 4) AS cents_percent FROM gaps g GROUP BY rank, path""")
def reduce_paths(spark, sf_dir):
    found = reduction.reduce_paths(trace(spark, sf_dir), ["rank", "path"], "t", ("cents",), total=1e6)
    return found.select("rank", "path", "n", "t_first", "t_last", *["cents_sum" if c == "cents_sum" else r4(c) for c in found.columns[5:]])


@query(f"WITH {_RED} SELECT rank, path, n, round(share, 4) AS share FROM shared")
def explained_share(spark, sf_dir):
    return _shared(spark, sf_dir).select("rank", "path", "n", r4("share"))


@query(f"WITH {_RED} SELECT rank, path, n, round(share, 4) AS share FROM shared WHERE n > 1 AND n - total * 1.0 / gap_mean > 0")
def keep_above_share(spark, sf_dir):
    return reduction.keep_above(_shared(spark, sf_dir), 1.0).select("rank", "path", "n", r4("share"))


@query(f"WITH {_RED} SELECT rank, path, n, round(share, 4) AS share FROM shared WHERE n - total * 0.9 / gap_mean > 0 AND n - total * 1.0 / gap_mean <= 0")
def share_range(spark, sf_dir):
    return reduction.share_between(_shared(spark, sf_dir), 0.9, 1.0).select("rank", "path", "n", r4("share"))


@query(f"WITH {_RED} SELECT path, count(*) AS n_ranks, round(sum(share) / count(*), 4) AS global_share, round(avg(gap_median), 4) AS gap_median FROM shared GROUP BY path")
def path_profile(spark, sf_dir):
    rows = _shared(spark, sf_dir, medians=True)
    found = reduction.over_ranks(rows, ["path"], "rank", ("share",)).drop("ranks")
    return found.join(rows.groupBy("path").agg(r4_agg("gap_median")), "path").select("path", F.col("n_ranks").cast("long").alias("n_ranks"), r4("global_share"), "gap_median")


def r4_agg(c: str) -> Column:
    return F.round(F.avg(c), 4).alias(c)


# Phases


@query(f"""WITH {_RED}, marked AS (SELECT *, CASE WHEN share - lag(share) OVER (ORDER BY share) > 0.01 THEN 1 ELSE 0 END AS new FROM shared WHERE share IS NOT NULL),
isl AS (SELECT *, CAST(sum(new) OVER (ORDER BY share RANGE UNBOUNDED PRECEDING) AS BIGINT) AS phase_id FROM marked)
SELECT rank, path, phase_id, round(avg(share) OVER (PARTITION BY phase_id), 2) AS phase FROM isl""")
def phase_islands(spark, sf_dir):
    return phases.phases(_shared(spark, sf_dir).where("share is not null"), 0.01).select("rank", "path", "phase_id", "phase")


@query(f"""WITH {_RED}, grid AS (SELECT round(k * 0.01, 6) AS g FROM range(1, 100) r(k)),
costs AS (SELECT g, round(avg(abs(n - total * g / gap_mean)), 6) AS c FROM shared, grid WHERE n > 1 GROUP BY g)
SELECT g AS share, c AS mean_cost FROM costs ORDER BY c, g LIMIT 1""")
def best_single_share(spark, sf_dir):
    return phases.best_share(_shared(spark, sf_dir))


_NEAR = """near AS (SELECT rank, path, x, y, c FROM (SELECT rank, path, CAST(n AS DOUBLE) AS x, gap_mean AS y, 0.9 * total AS c FROM shared WHERE n > 1)),
step AS (SELECT rank, path, c, CASE WHEN abs(x * y - c) < 1e-12 THEN x ELSE (x + (x + c / y) / 2) / 2 END AS x, CASE WHEN abs(x * y - c) < 1e-12 THEN y ELSE (y + (y + c / x) / 2) / 2 END AS y FROM near),
dist AS (SELECT rank, path, CASE WHEN x = c / y OR y = c / x THEN 0 ELSE abs(x - c / y) * abs(y - c / x) / sqrt(pow(x - c / y, 2) + pow(y - c / x, 2)) END AS distance FROM step)"""


def _distances(spark, sf_dir):
    rows = _shared(spark, sf_dir).where("n > 1")
    return rows.withColumn("distance", phases.near_distance(F.col("n").cast("double"), F.col("gap_mean"), 0.9 * F.col("total")))


@query(f"WITH {_RED}, {_NEAR} SELECT rank, path, round(distance, 4) AS distance FROM dist")
def curve_distance(spark, sf_dir):
    return _distances(spark, sf_dir).select("rank", "path", r4("distance"))


@query(f"WITH {_RED}, {_NEAR} SELECT count(*) AS n, round(avg(distance * distance), 4) AS mean_square FROM dist WHERE distance <= 0.5")
def near_curve(spark, sf_dir):
    return phases.near_points(_distances(spark, sf_dir), "distance", 0.5).select("n", r4("mean_square"))


@query(f"""WITH {_RED} SELECT round(0.1 * s, 4) AS share, i, round(1000.0 + i * 100.0, 4) AS y, round(0.1 * s * total / (1000.0 + i * 100.0), 4) AS x FROM range(1, 10) a(s), range(0, 11) b(i), total""")
def curve_points(spark, sf_dir):
    total = reduction.total_time(trace(spark, sf_dir), "t")
    shares = total.select("total", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("s")).withColumn("share", 0.1 * F.col("s"))
    return phases.curve(shares, "share", F.col("total"), 1000.0, 2000.0, 11).select(r4("share"), F.col("i").cast("long").alias("i"), r4("y"), r4("x"))


@query()
def curve_distance_exact(spark, sf_dir):
    rows = _shared(spark, sf_dir).where("n > 1").withColumn("gap", F.col("gap_mean") / F.col("total"))
    return rows.select("rank", "path", F.round(phases.exact_distance(F.col("n").cast("double"), "gap", F.lit(0.9)), 4).alias("distance"))


@query()
def fitted_shares(spark, sf_dir):
    """Shares chosen so that their curves pass near all paths."""
    shared = _shared(spark, sf_dir).where("n > 1")
    total = reduction.total_time(trace(spark, sf_dir), "t").first()["total"]
    chosen = phases.fit_shares(shared, float(total), [k / 10 for k in range(1, 10)])
    return spark.createDataFrame([(c,) for c in chosen], "share double")


# Clusters

_NORM = """norm AS (SELECT rank, path, n, gap_mean, gap_median, share, n / CAST(max(n) OVER () AS DOUBLE) AS x, gap_mean / max(gap_mean) OVER () AS y FROM shared WHERE n > 1)"""


@query(f"WITH {_RED}, {_NORM} SELECT rank, path, round(x, 4) AS x, round(y, 4) AS y FROM norm")
def feature_norm(spark, sf_dir):
    return _features(spark, sf_dir).select("rank", "path", r4("x"), r4("y"))


def _features(spark, sf_dir):
    return clustering.normalise(_shared(spark, sf_dir, medians=True).where("n > 1"), {"n": "x", "gap_mean": "y"})


def _clusters(spark, sf_dir, eps: float = 0.02):
    found = clustering.eps_components(_features(spark, sf_dir), "x", "y", eps)
    first = F.struct("rank", "path")
    return clustering.in_first_member_order(found.withColumn("first", first), "component", "first")


_COMP = f"""WITH RECURSIVE {_RED}, {_NORM}, pts AS (SELECT *, row_number() OVER (ORDER BY rank, path) AS id FROM norm),
near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.0004),
reach AS (SELECT id AS src, id AS dst FROM pts UNION SELECT r.src, n.b FROM reach r JOIN near n ON n.a = r.dst),
lowest AS (SELECT src AS id, min(dst) AS root FROM reach GROUP BY src),
clustered AS (SELECT p.*, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster_id FROM pts p JOIN lowest USING (id))"""


@query(f"{_COMP} SELECT rank, path, cluster_id FROM clustered")
def loop_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("rank", "path", "cluster_id")


@query(f"{_COMP} SELECT cluster_id, count(*) AS members, round(arg_min(share, id), 4) AS phase, round(avg(gap_mean), 4) AS gap_mean, round(avg(gap_median), 4) AS gap_median FROM clustered GROUP BY cluster_id")
def cluster_summary(spark, sf_dir):
    found = clustering.summary(_clusters(spark, sf_dir), "cluster_id", "first", "share")
    return found.select("cluster_id", "members", *[r4(c) for c in ("phase", "gap_mean", "gap_median")])


@query(f"{_COMP} SELECT cluster_id, count(*) AS members, count(DISTINCT path) = 1 AS pure FROM clustered GROUP BY cluster_id")
def cluster_purity(spark, sf_dir):
    return clustering.purity(_clusters(spark, sf_dir), "cluster_id", "path")


@query(f"WITH {_RED} SELECT rank, path, CAST(dense_rank() OVER (ORDER BY path) - 1 AS BIGINT) AS cluster_id FROM reduced")
def clusters_by_label(spark, sf_dir):
    return clustering.by_loop(_reduced(spark, sf_dir), "path").select("rank", "path", "cluster_id")


# Aliasing

_MATRIX = f"""{_EV}, firsts AS (SELECT rank, path, t, seq, min(t) OVER (PARTITION BY rank, path) AS f FROM ev),
placed AS (SELECT rank, path, t, dense_rank() OVER (PARTITION BY rank ORDER BY f, path) AS row FROM firsts),
wrapped AS (SELECT *, coalesce(CAST(row <= lag(row) OVER (PARTITION BY rank ORDER BY t, row) AS INT), 0) AS w FROM placed),
matrix AS (SELECT rank, path, t, row, CAST(sum(w) OVER (PARTITION BY rank ORDER BY t, row ROWS UNBOUNDED PRECEDING) AS BIGINT) AS col, row_number() OVER (PARTITION BY rank, path ORDER BY t) - 1 AS nth FROM wrapped),
runs AS (SELECT rank, row, min(col) AS c0, max(col) AS c1, min(t) AS t0 FROM (SELECT *, col - row_number() OVER (PARTITION BY rank, row ORDER BY col) AS run FROM matrix) GROUP BY rank, row, run),
blocks AS (SELECT rank, c0, c1, min(row) AS r0, max(row) AS r1, min(t0) AS t0 FROM (SELECT *, row - row_number() OVER (PARTITION BY rank, c0, c1 ORDER BY row) AS island FROM runs) GROUP BY rank, c0, c1, island)"""


def _matrix(spark, sf_dir):
    return alias.wrap_columns(trace(spark, sf_dir), ["rank"], "path", "t")


def _blocks(spark, sf_dir):
    return alias.dense_blocks(alias.dense_runs(_matrix(spark, sf_dir), ["rank"]), ["rank"])


@query(f"WITH {_MATRIX} SELECT rank, path, t, row, col, nth FROM matrix")
def wrap_columns(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(f"WITH {_MATRIX} SELECT rank, max(CAST(col <> nth AS INT)) = 1 AS aliased FROM matrix GROUP BY rank")
def aliased_ranks(spark, sf_dir):
    return alias.aliased(_matrix(spark, sf_dir), ["rank"])


@query(f"WITH {_MATRIX} SELECT rank, r0, r1, c0, c1, t0 FROM blocks")
def dense_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("rank", "r0", "r1", "c0", "c1", "t0")


@query(f"WITH {_MATRIX} SELECT rank, r0, r1, count(*) AS n_blocks, CAST(sum(c1 - c0 + 1) AS BIGINT) AS iterations FROM blocks GROUP BY rank, r0, r1")
def subloop_groups(spark, sf_dir):
    return alias.subloops(_blocks(spark, sf_dir), ["rank"]).drop("spans")


@query(f"""WITH {_MATRIX}, seqs AS (SELECT rank, list(r0 || '-' || r1 ORDER BY t0, r0, r1) AS s FROM blocks GROUP BY rank),
per AS (SELECT rank, s, list_filter(range(1, len(s) + 1), lambda p: len(s) % p = 0 AND len(list_filter(range(0, len(s)), lambda i: s[i + 1] <> s[(i % p) + 1])) = 0)[1] AS period FROM seqs)
SELECT rank, CAST(period AS BIGINT) AS period, CAST(len(s) // period AS BIGINT) AS iterations, len(s) // period > 1 AND len(list_distinct(s)) > 1 AS hidden FROM per""")
def superloop_period(spark, sf_dir):
    found = alias.superloops(_blocks(spark, sf_dir), ["rank"])
    return found.withColumn("period", F.col("period").cast("long"))


# Nesting

_BETWEEN = f"""{_EV}, line AS (SELECT rank, t, path, sum(CASE WHEN path = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY rank ORDER BY t RANGE UNBOUNDED PRECEDING) AS interval, max(CASE WHEN path = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY rank, t) AS bound FROM ev WHERE path IN ('purchase', 'view')),
counts AS (SELECT rank, CAST(interval AS BIGINT) AS interval, CAST(sum(CASE WHEN path = 'view' AND bound = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_inner FROM line GROUP BY rank, interval),
inside AS (SELECT rank, interval, n_inner FROM (SELECT *, max(interval) OVER (PARTITION BY rank) AS last FROM counts) WHERE interval >= 1 AND interval < last)"""


def _of(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("path") == path)


@query(f"WITH {_BETWEEN} SELECT rank, interval, n_inner FROM inside")
def inner_per_iteration(spark, sf_dir):
    rows = trace(spark, sf_dir)
    return nesting.inner_per_interval(_of(rows, "purchase"), _of(rows, "view"), ["rank"], "t")


@query(f"WITH {_BETWEEN} SELECT rank, count(*) AS n_intervals, CAST(sum(CAST(n_inner > 0 AS INT)) AS BIGINT) AS n_hit, sum(CAST(n_inner > 0 AS INT)) = count(*) AS contained FROM inside GROUP BY rank")
def interval_contains(spark, sf_dir):
    rows = trace(spark, sf_dir)
    return nesting.contains(_of(rows, "purchase"), _of(rows, "view"), ["rank"], "t")


@query(f"WITH {_EV} SELECT rank, path, t FROM (SELECT *, row_number() OVER (PARTITION BY rank, path ORDER BY t) AS n FROM ev) WHERE (n - 1) % 3 = 0")
def thin_instants(spark, sf_dir):
    return nesting.thin(trace(spark, sf_dir), ["rank", "path"], "t", 3).select("rank", "path", "t")


@query(f"""WITH {_EV}, b AS (SELECT rank, t, row_number() OVER (PARTITION BY rank ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY rank) AS n FROM ev WHERE path = 'view'),
e AS (SELECT rank, t, row_number() OVER (PARTITION BY rank ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY rank) AS n FROM ev WHERE path = 'purchase'),
s AS (SELECT DISTINCT b.rank, greatest(b.n // e.n, 1) AS sb, greatest(e.n // b.n, 1) AS se FROM b JOIN e USING (rank))
SELECT b.rank, b.k // sb AS iteration, b.t AS t_begin, e.t AS t_end FROM b JOIN s USING (rank) JOIN e ON e.rank = b.rank AND e.k % se = 0 AND e.k // se = b.k // sb WHERE b.k % sb = 0""")
def iteration_bounds(spark, sf_dir):
    rows = trace(spark, sf_dir)
    return nesting.iteration_bounds(_of(rows, "view"), _of(rows, "purchase"), ["rank"], "t")


@query(f"""WITH {_RED}, l AS (SELECT path, sum(n) AS it, dense_rank() OVER (ORDER BY avg(gap_mean), path) AS j FROM reduced GROUP BY path)
SELECT a.j AS child, CAST(min(b.j) AS BIGINT) AS parent FROM l a JOIN l b ON b.j > a.j AND b.it <= a.it GROUP BY a.j""")
def nearest_parent(spark, sf_dir):
    loops = _reduced(spark, sf_dir).groupBy("path").agg(F.sum("n").alias("it"), F.avg("gap_mean").alias("gap"))
    loops = loops.withColumn("j", F.dense_rank().over(Window.orderBy("gap", "path")).cast("long"))
    pairs = loops.select(F.col("j").alias("child"), "it").join(loops.select(F.col("j").alias("parent"), F.col("it").alias("pit")), F.col("pit") <= F.col("it"))
    return nesting.nearest_parent(pairs, "child", "parent")


@query("""WITH loops AS (SELECT n_regionkey AS phase, CAST(n_nationkey % 3 AS BIGINT) AS loop, min(n_nationkey) AS first_line, max(n_nationkey) AS last_line, count(*) AS loop_iterations FROM nation GROUP BY 1, 2),
calls AS (SELECT n_nationkey AS call, n_regionkey AS phase, n_nationkey AS line, CAST(n_nationkey % 3 + 1 AS BIGINT) AS its FROM nation)
SELECT call, phase, line, its, CAST(loop AS BIGINT) AS loop FROM (SELECT c.*, l.loop, row_number() OVER (PARTITION BY c.call ORDER BY loop_iterations, l.loop) AS r FROM calls c JOIN loops l USING (phase) WHERE line > first_line AND line < last_line AND its <> loop_iterations) WHERE r = 1""")
def push_back(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    loops = n.groupBy(F.col("n_regionkey").alias("phase"), (F.col("n_nationkey") % 3).cast("long").alias("loop")).agg(F.min("n_nationkey").alias("first_line"), F.max("n_nationkey").alias("last_line"), F.count("*").alias("loop_iterations"))
    calls = n.select(F.col("n_nationkey").alias("call"), F.col("n_regionkey").alias("phase"), F.col("n_nationkey").alias("line"), (F.col("n_nationkey") % 3 + 1).cast("long").alias("its"))
    return nesting.push_back(calls, loops, "phase", "line", "its")


# Occurrences

_MARKS = f"{_EV}, marks AS (SELECT rank, t, seq, row_number() OVER (PARTITION BY rank ORDER BY t, seq) % 2 = 1 AS is_entry, cents FROM ev)"
_CALLS = f"{_MARKS}, calls AS (SELECT rank, t AS t_in, t_out, t_out - t AS duration FROM (SELECT *, lead(t) OVER w AS t_out, lead(is_entry) OVER w AS nxt FROM marks WINDOW w AS (PARTITION BY rank ORDER BY t, seq)) WHERE is_entry AND NOT nxt)"


def _marks(spark, sf_dir):
    along = Window.partitionBy("rank").orderBy("t", "seq")
    return trace(spark, sf_dir).withColumn("is_entry", F.row_number().over(along) % 2 == 1).select("rank", "t", "seq", "is_entry", "cents")


def _calls(spark, sf_dir):
    return occurrences.pair_calls(_marks(spark, sf_dir), ["rank"], "t", ["seq"], "is_entry").select("rank", "t_in", "t_out", "duration")


@query(f"WITH {_CALLS} SELECT * FROM calls")
def pair_open_close(spark, sf_dir):
    return _calls(spark, sf_dir)


@query(f"WITH {_CALLS} SELECT rank, t_in, t_out, t_in - coalesce(lag(t_out) OVER (PARTITION BY rank ORDER BY t_in), 0) AS burst_ns FROM calls")
def burst_gap(spark, sf_dir):
    return occurrences.bursts(_calls(spark, sf_dir), ["rank"]).select("rank", "t_in", "t_out", "burst_ns")


@query(f"WITH {_EV} SELECT rank, seq, t - max(CASE WHEN path = 'view' THEN t END) OVER (PARTITION BY rank ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM ev")
def since_outside(spark, sf_dir):
    rows = trace(spark, sf_dir).withColumn("outside", F.col("path") == "view")
    return occurrences.since_outside(rows, ["rank"], "t", ["seq"], "outside").select("rank", "seq", "gap")


@query(f"""WITH {_EV}, s AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY rank ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ev)
SELECT rank, path, seq, CAST(b - lag(b) OVER (PARTITION BY rank, path ORDER BY t, seq) AS BIGINT) AS between_cents FROM s""")
def iteration_counters(spark, sf_dir):
    return occurrences.iteration_counters(trace(spark, sf_dir), ["rank"], "path", "t", ["seq"], "cents").select("rank", "path", "seq", F.col("between").alias("between_cents"))


def _attribution(mode: str) -> str:
    own = "is_entry" if mode == "legacy" else "NOT is_entry"
    return f"SELECT '{mode}' AS mode, rank, CASE WHEN {own} THEN 'call' ELSE 'burst' END AS scope, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM marks GROUP BY ALL"


@query(f"WITH {_MARKS} {_attribution('legacy')} UNION ALL {_attribution('shifted')}")
def counter_attribution(spark, sf_dir):
    marks = _marks(spark, sf_dir)
    found = [occurrences.attribute(marks, marks, ["rank"], "t", "cents", m).withColumn("mode", F.lit(m)) for m in ("legacy", "shifted")]
    return found[0].unionByName(found[1])


@query("""WITH calls AS (SELECT o_orderkey AS call, o_custkey AS rank, epoch_us(o_orderdate) AS t_in, epoch_us(o_orderdate) + 1 AS t_out FROM orders),
msgs AS (SELECT o_custkey AS s, l_suppkey AS r, epoch_us(o_orderdate) AS ts, CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sums AS (SELECT s AS rank, ts AS t_in, sum(size) AS size, list_sort(list_distinct(list(r))) AS partners FROM msgs GROUP BY s, ts)
SELECT call, rank, t_in, CAST(coalesce(size, 0) AS BIGINT) AS msg_size, coalesce(array_to_string(partners, ','), '') AS partners FROM calls LEFT JOIN sums USING (rank, t_in)""")
def message_match(spark, sf_dir):
    o, item = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    calls = o.select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("rank"), micros("o_orderdate").alias("t_in"), (micros("o_orderdate") + 1).alias("t_out"))
    # Received at an instant that no call ends at, so that only senders' calls match.
    messages = item.join(o, item["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("send_task"), F.col("l_suppkey").alias("recv_task"), micros("o_orderdate").alias("t_send"), F.lit(-1).cast("long").alias("t_recv"), F.col("l_quantity").cast("long").alias("size"))
    return occurrences.match_messages(calls, messages).select("call", "rank", "t_in", "msg_size", F.array_join(F.col("partners").cast("array<string>"), ",").alias("partners"))


@query("SELECT n_nationkey AS event_type, n_regionkey AS value, coalesce(CASE WHEN r_regionkey <= 2 THEN r_name END, n_nationkey || '_' || n_regionkey) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def dictionary_fallback(spark, sf_dir):
    from loopscope.sources.trace import translate

    events = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("event_type"), F.col("n_regionkey").cast("string").alias("value"))
    names = _table(spark, sf_dir, "region").where("r_regionkey <= 2").select(F.col("r_regionkey").cast("string").alias("value"), F.col("r_name").alias("label"))
    found = translate(events, events.distinct().join(names, "value"))
    return found.select(F.col("event_type").cast("int").alias("event_type"), F.col("value").cast("int").alias("value"), "label")


@query("SELECT o_custkey AS rank, epoch_us(o_orderdate) AS t, count(*) AS n_lines, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS priorities FROM orders GROUP BY 1, 2")
def coalesce_same_instant(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rank"), micros("o_orderdate").alias("t"), "o_orderkey", "o_orderpriority")
    return occurrences.coalesce_instants(rows, ["rank"], "t", "o_orderkey", ["o_orderpriority"]).select("rank", "t", "n_lines", F.array_join("o_orderpriority", "|").alias("priorities"))


@query("SELECT o_custkey AS rank, o_orderkey AS seq, t, b AS t_before FROM (SELECT *, epoch_us(o_orderdate) AS t, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE t < b")
def monotonic_check(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rank"), F.col("o_orderkey").alias("seq"), micros("o_orderdate").alias("t"))
    return occurrences.backward_steps(rows, ["rank"], "seq", "t")


@query("""SELECT l_suppkey % 8 AS task, CAST(epoch_us(l_shipdate) AS BIGINT) AS t, pos, CAST(type AS VARCHAR) AS type, CAST(value AS BIGINT) AS value FROM (
SELECT *, 0 AS pos, '42000050' AS type, l_quantity AS value FROM lineitem UNION ALL SELECT *, 1, '50000001', l_linenumber FROM lineitem) """)
def explode_pairs(spark, sf_dir):
    from loopscope.sources.trace import events_of

    item = _table(spark, sf_dir, "lineitem")
    text = F.concat_ws(":", F.lit("2"), F.lit(1), F.lit(1), F.col("l_suppkey") % 8, F.lit(1), micros("l_shipdate"), F.lit("42000050"), F.col("l_quantity").cast("long"), F.lit("50000001"), F.col("l_linenumber"), F.lit("12345678"), F.lit(9))
    found = events_of(item.select(text.alias("value"), F.lit(0).cast("long").alias("line_no")))
    return found.select(F.col("task").cast("long").alias("task"), "t", F.col("pos").cast("int").alias("pos"), "type", "value")


# Ranks


@query(f"WITH {_EV} SELECT path, array_to_string(list_sort(list_distinct(list(rank))), ',') AS ranks, count(DISTINCT rank) AS n_ranks, min(t) AS place FROM ev GROUP BY path")
def rank_compaction(spark, sf_dir):
    found = ranks.compact(trace(spark, sf_dir).withColumn("all", F.lit(0)), ["all"], "path", "rank", "t")
    return found.select("path", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"), F.col("n_ranks").cast("long").alias("n_ranks"), "place")


@query(f"""WITH {_EV}, days AS (SELECT t // 86400000000 AS day, array_to_string(list_sort(list_distinct(list(rank % 3))), ',') AS ranks FROM ev GROUP BY 1),
n AS (SELECT *, CASE WHEN ranks <> lag(ranks) OVER (ORDER BY day) THEN 1 ELSE 0 END AS new FROM days), b AS (SELECT *, CAST(sum(new) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM n)
SELECT block, ranks, count(*) AS n_items, min(day) AS first, max(day) AS last FROM b GROUP BY block, ranks""")
def rank_blocks_flat(spark, sf_dir):
    days = trace(spark, sf_dir).groupBy(F.expr("t div 86400000000").alias("day")).agg(F.sort_array(F.collect_set(F.col("rank") % 3)).alias("ranks"))
    return ranks.flat_blocks(days, "day", "ranks").withColumn("ranks", F.array_join(F.col("ranks").cast("array<string>"), ","))


@query("""WITH s AS (SELECT n_regionkey AS id, list_distinct(list(n_nationkey % 4)) AS m FROM nation GROUP BY 1), u AS (SELECT * FROM s UNION ALL SELECT 100 + c_custkey % 6, list_distinct(list(c_nationkey % 5)) FROM customer GROUP BY 1)
SELECT a.id AS a, b.id AS b, CASE WHEN len(list_intersect(a.m, b.m)) = len(a.m) AND len(a.m) = len(b.m) THEN 'equal' WHEN len(list_intersect(a.m, b.m)) = len(a.m) THEN 'subset' WHEN len(list_intersect(a.m, b.m)) = len(b.m) THEN 'superset' WHEN len(list_intersect(a.m, b.m)) = 0 THEN 'disjoint' ELSE 'overlap' END AS relation FROM u a JOIN u b ON a.id < b.id""")
def set_relations(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("id")).agg(F.collect_set(F.col("n_nationkey") % 4).alias("m"))
    c = _table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 6 + 100).alias("id")).agg(F.collect_set(F.col("c_nationkey") % 5).alias("m"))
    u = n.unionByName(c)
    pairs = u.toDF("a", "ma").join(u.toDF("b", "mb"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", scalars.set_relation(F.col("ma"), F.col("mb")).alias("relation"))


@query(f"WITH {_EV} SELECT path, count(DISTINCT rank) AS n_ranks, round(sum(value) / count(DISTINCT rank), 4) AS global_value FROM ev GROUP BY path")
def global_metrics(spark, sf_dir):
    found = reduction.over_ranks(trace(spark, sf_dir), ["path"], "rank", ("value",))
    return found.select("path", F.col("n_ranks").cast("long").alias("n_ranks"), r4("global_value"))


@query("SELECT l_suppkey AS rank, round(avg(l_quantity) / avg(l_extendedprice), 8) AS ratio, round(stddev_pop(l_quantity), 4) AS spread, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_suppkey)")
def ratio_of_means_rollup(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "rank")
    return reduction.ratio_rollup(rows, "rank", "l_quantity", "l_extendedprice").select("rank", F.round("ratio", 8).alias("ratio"), r4("spread"), "n")


@query("SELECT round(avg(r), 8) AS ratio FROM (SELECT avg(l_quantity) / avg(l_extendedprice) AS r FROM lineitem WHERE l_suppkey < 20 GROUP BY l_suppkey)")
def subset_ratio(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").where("l_suppkey < 20").withColumnRenamed("l_suppkey", "rank")
    return reduction.mean_of_ratios(rows, "rank", "l_quantity", "l_extendedprice").select(F.round("ratio", 8).alias("ratio"))


@query(f"WITH {_RED} SELECT rank, path, round(CASE WHEN n < m THEN n / m END, 4) AS probability FROM (SELECT *, max(n) OVER (PARTITION BY rank) AS m FROM reduced)")
def exec_probability(spark, sf_dir):
    rows = _reduced(spark, sf_dir).withColumn("m", F.max("n").over(Window.partitionBy("rank")))
    return rows.select("rank", "path", F.round(reduction.probability(F.col("n"), F.col("m")), 4).alias("probability"))


def _two(x: str) -> str:
    """Two digits, halves up as written in decimals, as text."""
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(28, 12)), 2) AS DOUBLE) AS VARCHAR)"


def _ladder_sql(x: str, step: int, units: tuple[str, ...], op: str) -> str:
    arms = " ".join(f"WHEN {x} {op} {float(step**k)} THEN {_two(f"{x} / {float(step**k)}")} || '{u}'" for k, u in reversed(list(enumerate(units))) if k)
    return f"CASE {arms} ELSE {_two(x)} || '{units[0]}' END"


@query(f"SELECT o_orderkey, {_ladder_sql('o_totalprice', 1000, scalars.NS_UNITS, '>=')} AS time_text, {_ladder_sql('o_totalprice', 1024, scalars.BYTE_UNITS, '>')} AS size_text, {_ladder_sql('o_totalprice', 1000, scalars.BYTE_UNITS, '>=')} AS collective_text FROM orders")
def scale_units(spark, sf_dir):
    x = F.col("o_totalprice")
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.scale_time(x).alias("time_text"), scalars.scale_bytes(x).alias("size_text"), scalars.scale_bytes(x, collective=True).alias("collective_text"))


# Paths

_URL = "urls AS (SELECT page_id, url, string_split(url, '/') AS p FROM pages)"


def _urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.split("url", "/").alias("p"))


@query(f"""WITH {_URL}, g AS (SELECT p[1] || '//' || p[3] AS host, min(p) AS lo, max(p) AS hi, count(*) AS n FROM urls GROUP BY 1)
SELECT host, n, array_to_string(lo[1:len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda k: lo[1:k] = hi[1:k]))], '/') AS prefix FROM g""")
def group_lcp(spark, sf_dir):
    rows = _urls(spark, sf_dir).withColumn("host", F.concat(F.col("p")[0], F.lit("//"), F.col("p")[2]))
    return paths.group_common_prefix(rows, ["host"], "p").withColumn("prefix", F.array_join("prefix", "/"))


@query(f"""WITH {_URL}, l AS (SELECT page_id, p, lag(p) OVER (PARTITION BY p[1] ORDER BY url, page_id) AS b FROM urls)
SELECT page_id, CAST(CASE WHEN b IS NULL THEN 0 ELSE len(list_filter(range(1, least(len(p), len(b)) + 1), lambda k: p[1:k] = b[1:k])) END AS INT) AS hidden FROM l""")
def hide_repeated(spark, sf_dir):
    rows = _urls(spark, sf_dir).withColumn("scheme", F.col("p")[0])
    return paths.hide_repeated(rows, "p", ["url", "page_id"], ["scheme"]).select("page_id", "hidden")


@query(f"WITH {_URL} SELECT page_id, array_to_string(list_filter(p, lambda x: NOT list_contains(['http:', '', 'en'], x)), '/') AS rest FROM urls")
def path_minus(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", F.array_join(paths.minus(F.col("p"), F.array(F.lit("http:"), F.lit(""), F.lit("en"))), "/").alias("rest"))


@query(f"WITH {_URL} SELECT page_id, array_to_string(list_concat(p[1:1], p[1:len(p) - 1]), '/') AS shifted FROM urls")
def line_shift(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", F.array_join(paths.line_shift(F.col("p")), "/").alias("shifted"))


@query(f"WITH {_URL} SELECT page_id, CAST(coalesce(list_filter(range(1, greatest(len(p) - 1, 1) + 1), lambda i: p[i:i + 1] = p[3:4])[1] - 1, -1) AS INT) AS at FROM urls")
def sublist_index(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", paths.sublist_index(F.col("p"), F.slice("p", 3, 2)).alias("at"))


@query(f"WITH {_URL} SELECT page_id, array_to_string(flatten(list_transform(list_zip(p, list_reverse(p)), lambda x: [x[1], x[2]])), '/') AS mixed FROM urls")
def interleave_paths(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", F.array_join(paths.interleave(F.col("p"), F.reverse("p")), "/").alias("mixed"))


@query("""WITH s AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents), c AS (SELECT w, count(*) AS n, min(doc_id) AS f FROM s GROUP BY w)
SELECT w AS frame, n FROM c ORDER BY n DESC, f, w DESC LIMIT 1""")
def pivot_frame(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("p"))
    return flow.pivot(rows, "p", "doc_id")


@query("""WITH s AS (SELECT page_id, string_split(url, '/') AS p FROM pages), h AS (SELECT page_id, list_position(p, 'en') AS height FROM s WHERE list_contains(p, 'en'))
SELECT page_id, CAST(height AS BIGINT) AS height, CAST(max(height) OVER () - height AS BIGINT) AS pad FROM h""")
def align_paths(spark, sf_dir):
    return flow.align(_urls(spark, sf_dir), "p", "en").select("page_id", F.col("height").cast("long").alias("height"), "pad")


_EDGES = f"{_EV}, steps AS (SELECT rank, path AS src, lead(path) OVER (PARTITION BY rank ORDER BY t, seq) AS dst FROM ev), edges AS (SELECT src, dst, count(DISTINCT rank) AS n_ranks, count(*) AS n FROM steps WHERE dst IS NOT NULL GROUP BY src, dst)"


@query(f"WITH {_EDGES} SELECT * FROM edges")
def flow_edges(spark, sf_dir):
    found = flow.edges(trace(spark, sf_dir), "rank", "path", "t", ["seq"])
    return found.select("src", "dst", F.size("ranks").cast("long").alias("n_ranks"), "n")


@query("""WITH e AS (SELECT c_mktsegment AS src, c_mktsegment || c_nationkey % 2 AS dst FROM customer), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, node NOT IN (SELECT dst FROM e) AS head, node NOT IN (SELECT src FROM e) AS tail FROM n""")
def flow_ends(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return flow.ends(c.select(F.col("c_mktsegment").alias("src"), F.concat("c_mktsegment", (F.col("c_nationkey") % 2).cast("string")).alias("dst")))


# Marked loops

_INTERVALS = f"{_EV}, m AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY t, seq) % 2 AS odd FROM ev), iv AS (SELECT rank, path, t AS t_in, t_out, t_out - t AS duration, cents FROM (SELECT *, lead(t) OVER (PARTITION BY rank ORDER BY t, seq) AS t_out FROM m) WHERE odd = 1 AND t_out IS NOT NULL)"


def _intervals(spark, sf_dir):
    rows = trace(spark, sf_dir)
    marks = rows.withColumn("id", F.when(F.row_number().over(Window.partitionBy("rank").orderBy("t", "seq")) % 2 == 1, F.col("seq") + 1).otherwise(F.lit(0)))
    found = loopstats.intervals(marks, ["rank"], "t", ["seq"], "id")
    return found.withColumn("seq", F.col("id") - 1).join(rows.select("seq", "path", "cents"), "seq")


@query(f"WITH {_INTERVALS} SELECT rank, path, count(*) AS n, round(avg(duration), 4) AS mean, round(median(duration), 4) AS median, round(stddev_pop(duration), 4) AS stdev, round(avg(cents), 4) AS cents_mean FROM iv GROUP BY rank, path")
def loop_intervals_stats(spark, sf_dir):
    found = loopstats.statistics(_intervals(spark, sf_dir), ["rank", "path"], "duration", ("cents",))
    return found.select("rank", "path", "n", *[r4(c) for c in ("mean", "median", "stdev", "cents_mean")])


@query(f"""WITH {_INTERVALS}, s AS (SELECT rank, path, count(*) AS n, avg(duration) AS mean, stddev_pop(duration) AS stdev FROM iv GROUP BY rank, path)
SELECT path, count(*) AS n_ranks, round(avg(n), 4) AS n, round(avg(mean), 4) AS mean, round(avg(stdev), 4) AS stdev FROM s GROUP BY path""")
def merge_over_ranks(spark, sf_dir):
    stats = loopstats.statistics(_intervals(spark, sf_dir), ["rank", "path"], "duration")
    found = loopstats.merge_over_ranks(stats, ["path"], ["n", "mean", "stdev"])
    return found.select("path", "n_ranks", *[r4(c) for c in ("n", "mean", "stdev")])


@query(f"""WITH {_INTERVALS}, last AS (SELECT e.rank, e.seq, e.t, (SELECT max(t_in) FROM iv WHERE iv.rank = e.rank AND iv.t_in <= e.t) AS b FROM ev e WHERE e.path = 'click')
SELECT l.rank, l.seq, CASE WHEN iv.t_out > l.t THEN iv.t_in END AS owner_t FROM last l LEFT JOIN iv ON iv.rank = l.rank AND iv.t_in = l.b""")
def owner_intervals(spark, sf_dir):
    clicks = _of(trace(spark, sf_dir), "click").select("rank", "seq", "t")
    outer = _intervals(spark, sf_dir).select("rank", F.col("t_in").alias("id"), "t_in", "t_out")
    return loopstats.owner(clicks, outer, ["rank"], "t", "owner_t").select("rank", "seq", "owner_t")


@query(f"WITH {_RED} SELECT rank, path, round(n / pow(0.2, n % 3 + 1), 4) AS iterations FROM reduced")
def sampling_reconstruction(spark, sf_dir):
    return _reduced(spark, sf_dir).select("rank", "path", F.round(scalars.reconstructed(F.col("n"), 0.2, F.col("n") % 3), 4).alias("iterations"))


@query("SELECT l_returnflag AS plane, l_suppkey AS rank, CAST(least(floor((l_quantity - 1) / 4.5), 9) AS BIGINT) AS bucket, count(*) AS n FROM lineitem WHERE l_quantity >= 1 GROUP BY ALL")
def histogram_3d(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("plane"), F.col("l_suppkey").alias("rank"), "l_quantity")
    return loopstats.histogram(rows, ["plane", "rank"], "l_quantity", 1.0, 4.5, 10)


@query("""WITH c AS (SELECT l_returnflag AS plane, CASE l_linestatus WHEN 'O' THEN 'Total' ELSE 'Average' END AS r, round(sum(l_quantity) / 1e3, 2) AS a, round(sum(l_tax), 2) AS b FROM lineitem GROUP BY ALL)
SELECT plane, CAST(max(round(CAST((a + b) / 2 AS DECIMAL(18, 8)), 2)) FILTER (r = 'Total') AS DOUBLE) AS Total, CAST(max(round(CAST((a + b) / 2 AS DECIMAL(18, 8)), 2)) FILTER (r = 'Average') AS DOUBLE) AS Average FROM c GROUP BY plane""")
def plane_stats_pivot(spark, sf_dir):
    item = _table(spark, sf_dir, "lineitem")
    row = F.when(F.col("l_linestatus") == "O", "Total").otherwise("Average")
    cells = item.groupBy(F.col("l_returnflag").alias("plane"), row.alias("row")).agg(F.array(F.lit(-1.0), F.round(F.sum("l_quantity") / 1e3, 2), F.round(F.sum("l_tax"), 2), F.lit(-1.0)).alias("values"))
    return loopstats.plane_statistics(cells, "plane", "row", "values", ("Total", "Average"))


@query("SELECT p_partkey, list_reduce(list_transform(string_split(p_name || '_' || p_size, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (h * 33 + c) & 4294967295, CAST(5381 AS BIGINT)) AS uid FROM part")
def djb2_uid(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", scalars.uid(F.concat_ws("_", "p_name", "p_size")).alias("uid"))


@query(f"""WITH {_EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY rank ORDER BY t, seq) < 7200000000 THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY rank ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT rank, min(t) AS t_first, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY rank, b""")
def session_bursts(spark, sf_dir):
    from loopscope.streaming.online import sessions

    rows = trace(spark, sf_dir).withColumn("ts", F.timestamp_micros("t"))
    return sessions(rows, "2 hours").select("rank", "t_first", "n", "cents")


@query("SELECT l_suppkey % 8 AS task, kind, count(*) AS n FROM (SELECT l_suppkey, CASE WHEN l_linenumber % 4 = 0 THEN 'comm' ELSE 'task' END AS kind FROM lineitem) GROUP BY ALL")
def split_counts(spark, sf_dir):
    """Records by the file that a split trace would keep them in."""
    from loopscope.sources.trace import split_kinds

    item = _table(spark, sf_dir, "lineitem")
    text = F.concat_ws(":", F.when(F.col("l_linenumber") % 4 == 0, "3").otherwise("2"), F.lit(1), F.lit(1), F.col("l_suppkey") % 8, F.lit(1), F.lit(5))
    found = split_kinds(item.select(text.alias("value")))
    return found.groupBy(F.col("task").cast("long").alias("task"), "kind").agg(F.count("*").alias("n"))


# Trace text

_TRACE = f"""{_EV}, tm AS (SELECT *, row_number() OVER w AS n, lead(t) OVER w AS t_out, lag(t) OVER w AS t_b, lag(cents) OVER w AS cents_b FROM ev WINDOW w AS (PARTITION BY rank ORDER BY t, seq)),
made AS (SELECT rank, t, t_out, 'main(42) ' || CASE k % 3 WHEN 0 THEN 'work' ELSE '70000001_' || (k % 3 + 10) END || '(' || k || ') ' || CASE length(path) WHEN 4 THEN 'MPI_Send' WHEN 5 THEN 'MPI_Bcast' ELSE '50000001_' || length(path) END || '(0)' AS path,
 cents + 1000 AS ins, CAST(2000 AS BIGINT) AS cyc, t - coalesce(t_b, 0) AS burst_ns, cents_b AS burst_ins, CAST(CASE WHEN cents_b IS NOT NULL THEN 100 END AS BIGINT) AS burst_cyc,
 CASE WHEN length(path) = 5 THEN cents END AS send_size, CASE WHEN length(path) = 5 THEN 2 * cents END AS recv_size, CAST(CASE WHEN length(path) = 5 THEN 1 END AS BIGINT) AS communicator FROM tm WHERE n % 2 = 1 AND t_out IS NOT NULL)"""


def trace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the lines of a trace: of each rank's events every odd one enters a call, with its callers, and the next one ends it."""
    along = Window.partitionBy("rank").orderBy("t", "seq")
    rows = trace(spark, sf_dir).withColumn("odd", F.row_number().over(along) % 2 == 1).withColumn("code", F.length("path"))
    head = [F.lit("2:1:1"), F.col("rank") + 1, F.lit(1), F.col("t")]
    callers = F.concat_ws(":", F.lit("70000001"), F.col("k") % 3 + 10, F.lit("80000001"), F.col("k"), F.lit("70000002:1:80000002:5:70000003:2:80000003:9"))
    sizes = F.when(F.col("code") == 5, F.concat_ws(":", F.lit("50100001"), F.col("cents"), F.lit("50100002"), 2 * F.col("cents"), F.lit("50100004:1")))
    enter = F.concat_ws(":", *head, F.lit("50000001"), F.col("code"), callers, F.lit("42000050"), F.col("cents") + 1000, F.lit("42000059:2000"), sizes)
    leave = F.concat_ws(":", *head, F.lit("50000001:0:42000050"), F.col("cents"), F.lit("42000059:100"))
    return rows.select(F.when(F.col("odd"), enter).otherwise(leave).alias("value"), F.col("seq").alias("line_no"))


def trace_labels(spark: SparkSession) -> DataFrame:
    """The dictionary of ``trace_text``; calls and callers that it lacks go by their numbers."""
    rows = [("50000001", 4, "MPI_Send"), ("50000001", 5, "MPI_Bcast"), ("70000001", 10, "x [work<int>]"), ("70000002", 1, "main"), ("70000003", 2, "start"), ("80000002", 5, "42 (main.c, prog)")]
    return spark.createDataFrame(rows, "event_type string, value long, label string")


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopscope.sources import trace as source

    events = source.events_of(trace_text(spark, sf_dir))
    named = source.translate(events.withColumnRenamed("type", "event_type"), trace_labels(spark))
    return named.withColumnRenamed("event_type", "type")


@query(f"WITH {_TRACE} SELECT * FROM made")
def trace_calls(spark, sf_dir):
    """From the text of a trace to its calls, with counters, bursts and sizes."""
    from loopscope.operators import callstacks

    return callstacks.occurrences_of(labelled_events(spark, sf_dir)).withColumn("path", paths.path_text(F.col("path")))


@query(f"""WITH {_TRACE}, m AS (SELECT rank, t, CAST(seq % 7 AS BIGINT) AS other, seq % 100 AS size FROM tm WHERE n % 2 = 1 AND t_out IS NOT NULL AND path = 'view')
SELECT made.rank, made.t, made.path, CAST(coalesce(size, 0) AS BIGINT) AS msg_size, coalesce(CAST(other AS VARCHAR), '-1') AS partners FROM made LEFT JOIN m USING (rank, t)""")
def trace_partners(spark, sf_dir):
    """Calls of a trace with the sizes and partners of the messages that they send."""
    from loopscope.operators import callstacks
    from loopscope.sources import trace as source

    along = Window.partitionBy("rank").orderBy("t", "seq")
    sent = trace(spark, sf_dir).withColumn("n", F.row_number().over(along)).withColumn("last", F.lead("t").over(along).isNull()).where("n % 2 = 1 and not last and path = 'view'")
    text = F.concat_ws(":", F.lit("3:1:1"), F.col("rank") + 1, F.lit(1), F.col("t"), F.col("t"), F.lit("1:1"), F.col("seq") % 7 + 1, F.lit("1:-1:-1"), F.col("seq") % 100, F.lit(0))
    messages = source.messages_of(sent.select(text.alias("value")))
    found = callstacks.occurrences_of(labelled_events(spark, sf_dir), messages)
    return found.select("rank", "t", paths.path_text(F.col("path")).alias("path"), "msg_size", F.array_join(F.col("partners").cast("array<string>"), ",").alias("partners"))


@query(f"""WITH {_EV}, tm AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY t, seq) % 2 AS odd FROM ev)
SELECT family, meaning, count(*) AS n FROM (
SELECT 'MPI' AS family, CASE odd WHEN 1 THEN 'enter' ELSE 'exit' END AS meaning FROM tm UNION ALL SELECT 'HWC', 'counter' FROM tm, range(2)
UNION ALL SELECT 'CALL', 'caller ' || r.range FROM tm, range(1, 4) r WHERE odd = 1 UNION ALL SELECT 'LINE', 'line ' || r.range FROM tm, range(1, 4) r WHERE odd = 1
UNION ALL SELECT 'GLOP', unnest(['send size', 'receive size', 'communicator']) FROM tm WHERE odd = 1 AND length(path) = 5) GROUP BY ALL""")
def event_meanings(spark, sf_dir):
    from loopscope.sources import trace as source

    return source.decoded(labelled_events(spark, sf_dir)).groupBy("family", "meaning").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_custkey AS INT) AS task, 1 AS thread, epoch_us(o_orderdate) AS t0, epoch_us(o_orderdate) + 5 AS t1, CAST(o_orderkey % 9 AS INT) AS state FROM orders")
def trace_states(spark, sf_dir):
    from loopscope.sources.trace import states_of

    t = micros("o_orderdate")
    text = F.concat_ws(":", F.lit("1:1:1"), F.col("o_custkey"), F.lit(1), t, t + 5, F.col("o_orderkey") % 9)
    return states_of(_table(spark, sf_dir, "orders").select(text.alias("value")))


@query("""SELECT l_suppkey AS send_task, CAST(1 AS BIGINT) AS send_thread, epoch_us(l_shipdate) AS t_send, epoch_us(l_shipdate) + 1 AS p_send, l_partkey AS recv_task, CAST(1 AS BIGINT) AS recv_thread, epoch_us(l_shipdate) + 7 AS t_recv,
epoch_us(l_shipdate) + 8 AS p_recv, CAST(l_quantity AS BIGINT) AS size, CAST(l_linenumber AS BIGINT) AS tag FROM lineitem""")
def trace_messages(spark, sf_dir):
    from loopscope.sources.trace import messages_of

    t = micros("l_shipdate")
    text = F.concat_ws(":", F.lit("3:1:1"), F.col("l_suppkey"), F.lit(1), t, t + 1, F.lit("1:1"), F.col("l_partkey"), F.lit(1), t + 7, t + 8, F.col("l_quantity").cast("long"), F.col("l_linenumber"))
    return messages_of(_table(spark, sf_dir, "lineitem").select(text.alias("value")))


@query("SELECT n_name AS date, CAST(1000 + n_nationkey AS BIGINT) AS total, CAST(n_regionkey + 2 AS INT) AS tasks FROM nation")
def trace_headers(spark, sf_dir):
    from loopscope.sources.trace import header_of

    text = F.concat(F.lit("#Trace ("), F.col("n_name"), F.lit("):"), (F.col("n_nationkey") + 1000).cast("string"), F.lit("_ns:1(4):1:"), (F.col("n_regionkey") + 2).cast("string"), F.lit("(1:1)"))
    return header_of(_table(spark, sf_dir, "nation").select(text.alias("value")))


def _dictionary(spark, sf_dir):
    """One block of a dictionary's text for each region, one of its values for each nation."""
    from loopscope.sources.trace import dictionary_of

    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    values = both.groupBy("r_regionkey", "r_name").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", F.col("n_nationkey").cast("string"), "n_name"))), "\n").alias("v"))
    block = F.concat(F.lit("EVENT_TYPE\n0 "), (F.col("r_regionkey") + 100).cast("string"), F.lit(" "), F.col("r_name"), F.lit("\nVALUES\n"), F.col("v"), F.lit("\n\n"))
    return dictionary_of(values.agg(F.array_join(F.collect_list(block), "").alias("value")))


@query("SELECT CAST(100 + r_regionkey AS VARCHAR) AS event_type, r_name AS type_name, CAST(n_nationkey AS VARCHAR) AS value, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def trace_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query("SELECT CAST(100 + r_regionkey AS VARCHAR) AS event_type, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(r_name, 'IC')")
def dictionary_matching(spark, sf_dir):
    from loopscope.sources.trace import matching

    return matching(_dictionary(spark, sf_dir), "IC").select("event_type", "label")


@query("SELECT p_partkey, p_name AS fn, p_size AS line, p_name AS file, p_brand AS image, p_brand AS counter FROM part")
def label_parts(spark, sf_dir):
    from loopscope.sources.trace import call_name, counter_name, line_parts

    size = F.col("p_size").cast("string")
    line = line_parts(F.concat(size, F.lit(" ("), F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(")")))
    fn = call_name(F.concat(F.lit("x ["), F.col("p_name"), F.lit("<"), size, F.lit(">]")))
    return _table(spark, sf_dir, "part").select("p_partkey", fn.alias("fn"), line["line"].alias("line"), line["file"].alias("file"), line["image"].alias("image"), counter_name(F.concat("p_brand", F.lit(" of "), "p_name")).alias("counter"))


@query(f"WITH {_EV}, m AS (SELECT rank, t, seq, path = 'view' AS is_entry, lag(path = 'view') OVER (PARTITION BY rank ORDER BY t, seq) AS b FROM ev) SELECT rank, t, seq, is_entry FROM m WHERE is_entry = coalesce(b, false)")
def unpaired_marks(spark, sf_dir):
    marks = trace(spark, sf_dir).select("rank", "t", "seq", (F.col("path") == "view").alias("is_entry"))
    return occurrences.unpaired(marks, ["rank"], "t", ["seq"], "is_entry")


@query(f"""WITH {_INTERVALS}, c AS (SELECT e.rank, e.seq, max(iv.t_in) AS b FROM ev e LEFT JOIN iv ON iv.rank = e.rank AND iv.t_in <= e.t WHERE e.path = 'click' GROUP BY ALL)
SELECT c.rank, c.seq, CASE WHEN iv.t_out > e.t THEN CAST(iv.t_in AS VARCHAR) ELSE '' END AS loop_stack FROM c JOIN ev e USING (rank, seq) LEFT JOIN iv ON iv.rank = c.rank AND iv.t_in = c.b""")
def loop_stack_at_entry(spark, sf_dir):
    clicks = _of(trace(spark, sf_dir), "click").select("rank", "seq", "t")
    loops = _intervals(spark, sf_dir).select("rank", F.col("t_in").alias("loop"), F.lit(0).alias("level"), "t_in", "t_out")
    found = occurrences.loop_stacks(clicks, loops, ["rank"], "t")
    return found.select("rank", "seq", F.array_join(F.col("loop_stack").cast("array<string>"), ",").alias("loop_stack"))


@query("""WITH calls AS (SELECT o_orderkey AS call, o_custkey AS rank, epoch_us(o_orderdate) AS t_in, epoch_us(o_orderdate) + 1 AS t_out FROM orders),
msgs AS (SELECT o_custkey AS r, l_suppkey AS s, epoch_us(o_orderdate) + 1 AS tr, CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sums AS (SELECT r AS rank, tr AS t_out, sum(size) AS size, list_sort(list_distinct(list(s))) AS partners FROM msgs GROUP BY r, tr)
SELECT call, rank, t_in, CAST(coalesce(size, 0) AS BIGINT) AS msg_size, coalesce(array_to_string(partners, ','), '') AS partners FROM calls LEFT JOIN sums USING (rank, t_out)""")
def message_receive(spark, sf_dir):
    o, item = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    calls = o.select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("rank"), micros("o_orderdate").alias("t_in"), (micros("o_orderdate") + 1).alias("t_out"))
    # Sent at an instant that no call starts at, so that only receivers' calls match.
    messages = item.join(o, item["l_orderkey"] == o["o_orderkey"]).select(F.col("l_suppkey").alias("send_task"), F.col("o_custkey").alias("recv_task"), F.lit(-1).cast("long").alias("t_send"), (micros("o_orderdate") + 1).alias("t_recv"), F.col("l_quantity").cast("long").alias("size"))
    return occurrences.match_messages(calls, messages).select("call", "rank", "t_in", "msg_size", F.array_join(F.col("partners").cast("array<string>"), ",").alias("partners"))


@query("SELECT n_nationkey, n_name || '(CommId:' || n_regionkey || ')' AS label FROM nation")
def collective_labels(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", scalars.collective_label(F.col("n_name"), F.col("n_regionkey")).alias("label"))


@query(f"WITH {_URL} SELECT page_id, coalesce(p = lag(p) OVER (PARTITION BY p[3] ORDER BY url, page_id), false) AS same, array_to_string(list_concat(p[1:1], p[3:3]), ' ') AS joined FROM urls")
def same_flow(spark, sf_dir):
    frames = F.transform("p", lambda x, i: F.struct(x.alias("fn"), i.alias("line"), F.col("page_id").alias("file")))
    rows = _urls(spark, sf_dir).withColumn("f", frames).withColumn("b", F.lag("f").over(Window.partitionBy(F.col("p")[2]).orderBy("url", "page_id")))
    joined = F.array_join(paths.plus(F.slice("p", 1, 1), F.slice("p", 3, 1)), " ")
    return rows.select("page_id", F.coalesce(paths.same_flow(F.col("f"), F.col("b")), F.lit(False)).alias("same"), joined.alias("joined"))


# Rows of other reports


@query("SELECT n_nationkey, rpad(substr(n_name, 1, 8), 8, ' ') AS left_cell, lpad(substr(n_name, 1, 5), 5, ' ') AS right_cell FROM nation")
def table_cells(spark, sf_dir):
    from loopscope.plans.render import cell

    return _table(spark, sf_dir, "nation").select("n_nationkey", cell(F.col("n_name"), 8).alias("left_cell"), cell(F.col("n_name"), 5, left=False).alias("right_cell"))


@query(f"""WITH {_INTERVALS}, s AS (SELECT rank, path, count(*) AS n, avg(duration) AS mean, stddev_pop(duration) AS stdev, avg(cents) AS c FROM iv GROUP BY rank, path)
SELECT rank AS "Rank", path AS "Loop loc.", n AS "Total iters", round(mean, 4) AS "Iter time m", round(stdev, 4) AS "Iter time std", round(c, 4) AS cents_mean FROM s WHERE n > 1""")
def loop_report(spark, sf_dir):
    stats = loopstats.statistics(_intervals(spark, sf_dir), ["rank", "path"], "duration", ("cents",))
    rows = stats.select("rank", F.col("path").alias("loop_loc"), F.col("n").alias("total_iters"), r4("mean", "iter_time_mean"), r4("stdev", "iter_time_std"), F.create_map(F.lit("cents"), r4("cents_mean")).alias("counter"))
    return loopstats.csv_rows(rows, ["cents"])


@query("SELECT l_suppkey AS rank, count(*) AS n_paths FROM lineitem WHERE l_linenumber = 4 GROUP BY 1")
def at_share(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rank"), F.col("l_linenumber").alias("n"), F.lit(1.0).alias("gap_mean"), F.lit(4.0).alias("total"))
    return reduction.at_share(rows, 1.0).groupBy("rank").agg(F.count("*").alias("n_paths"))


@query("""WITH m AS (SELECT greatest((SELECT max(o_totalprice) FROM orders), (SELECT max(l_extendedprice) FROM lineitem)) AS m)
SELECT 'o' AS side, o_orderkey AS k, CAST(0 AS BIGINT) AS line, round(o_totalprice / m, 6) AS x FROM orders, m UNION ALL SELECT 'l', l_orderkey, CAST(l_linenumber AS BIGINT), round(l_extendedprice / m, 6) FROM lineitem, m""")
def joint_norm(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.lit("o").alias("side"), F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("line"), F.col("o_totalprice").alias("v"))
    item = _table(spark, sf_dir, "lineitem").select(F.lit("l").alias("side"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_extendedprice").alias("v"))
    a, b = clustering.normalise_jointly([o, item], {"v": "x"})
    return a.unionByName(b).select("side", "k", "line", F.round("x", 6).alias("x"))


# Streams, over whole tables


@query(f"WITH {_EV} SELECT rank, path, count(*) AS n, min(t) AS t_first, max(t) AS t_last, round((max(t) - min(t)) / nullif(count(*) - 1, 0), 4) AS gap_mean, CAST(sum(cents) AS BIGINT) AS cents_sum, round(avg(cents), 4) AS cents_mean, round(stddev_pop(cents), 4) AS cents_stdev FROM ev GROUP BY rank, path")
def online_reduction(spark, sf_dir):
    from loopscope.streaming.online import reduce_online

    found = reduce_online(trace(spark, sf_dir), ["rank", "path"], "t", "cents")
    return found.select("rank", "path", "n", "t_first", "t_last", r4("gap_mean"), "cents_sum", r4("cents_mean"), r4("cents_stdev"))


@query(f"WITH {_EV} SELECT CAST(t // 3600000000 * 3600000000 AS BIGINT) AS start, path, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    from loopscope.streaming.online import windows

    found = windows(trace(spark, sf_dir).withColumn("ts", F.timestamp_micros("t")), "1 hour")
    return found.select(F.unix_micros("start").alias("start"), "path", "n", "cents")


@query(f"""WITH {_EV}, d AS (SELECT rank, path, seq, [CAST(rank AS VARCHAR), rank || '/' || path, rank || '/' || path || '/' || seq] AS keys FROM ev)
SELECT rank, path, seq FROM d WHERE len(list_filter(keys, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) < {int(0.7 * (1 << 32))})) = 3""")
def sampled_iterations(spark, sf_dir):
    from loopscope.streaming.online import kept_by_sampling

    rows = trace(spark, sf_dir).select("rank", "path", "seq").withColumn("around", F.array(F.col("rank").cast("string"), F.col("path"), F.col("seq").cast("string")))
    return kept_by_sampling(rows, 0.7, "around").drop("around")


@query(f"WITH {_EV} SELECT a.seq AS message, a.rank AS send_task, CASE WHEN b.path = 'view' THEN b.rank END AS recv_task FROM ev a LEFT JOIN ev b ON a.seq = b.seq AND b.path = 'view'")
def outer_message_match(spark, sf_dir):
    from loopscope.streaming.online import match_messages

    rows = trace(spark, sf_dir).select(F.col("seq").alias("message"), F.timestamp_micros("t").alias("ts"), F.col("rank").alias("task"), "path")
    return match_messages(rows.drop("path"), rows.where("path = 'view'").drop("path"), "1 hour", "1 hour").select("message", "send_task", "recv_task")
