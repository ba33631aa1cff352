"""Resolution, reshaping, records and ratings on the golden cases."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorebook.functions.ordered import last_value_so_far, number_rows, previous_value
from scorebook.operators import ratings as rt
from scorebook.operators import records as rc
from scorebook.operators import reshape as rs
from scorebook.operators import resolve as rv

GAMES = ("season int, home_team_id long, away_team_id long, game_date date, is_scrimmage boolean, home_score int, "
         "away_score int, status string")
SCHEDULE = ("team_id string, opponent string, is_home boolean, team_score int, opp_score int, game_date date, "
            "game_time string, season int, is_conference boolean, is_ot boolean")


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame(
        [(1, "mt_view", "Mountain View", 11), (2, "grant", "Grant/Central Eastside", 12),
         (3, "nelson", "Clackamas/Nelson", 13), (4, "corvallis", "Corvallis/Crescent Valley", 14),
         (5, "west_salem", "West Salem", 15), (6, "borah", "Borah HS (ID)", None)],
        "team_id long, slug string, name string, home_venue_id long")


@pytest.fixture(scope="module")
def aliases(spark, teams):
    variants = spark.createDataFrame(
        [(1, "Mt. View", 2), (2, "Grant Central Eastside", 2), (3, "Nelson", 2), (4, "Corvallis", 2),
         (4, "Crescent Valley", 3)], "team_id long, alias string, pos int")
    return rv.build_aliases(teams, variants)


def test_alias_lookups(spark, rows, teams, aliases):
    raw = ["mt_view", "Mountain View", "Mt. View", "grant", "Grant/Central Eastside", "Grant Central Eastside", "nelson",
           "Clackamas/Nelson", "Nelson", "Corvallis", "Crescent Valley", "West Salem", "borah", "Borah HS (ID)"]
    expected = dict(zip(raw, [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 6, 6]))
    df = spark.createDataFrame([(v,) for v in raw], "raw string")
    assert rows(rv.resolve(df, "raw", aliases), "raw", "resolved_id") == sorted(expected.items(), key=repr)


def test_first_claim_of_an_alias_wins_and_is_reported(spark, rows, teams):
    variants = spark.createDataFrame([(1, "Rivals", 2), (2, " RIVALS", 2)], "team_id long, alias string, pos int")
    built = rv.build_aliases(teams, variants)
    assert rows(built.filter("alias_normalized = 'rivals'"), "team_id") == [(1,)]
    assert rows(rv.alias_collisions(teams, variants)) == [("rivals", 2, 1)]


def test_perspective_to_neutral(spark, rows, teams, aliases):
    day, later = date(2026, 3, 16), date(2026, 3, 20)
    sched = spark.createDataFrame([
        ("mt_view", "grant", True, 9, 7, day, "4pm", 2026, True, False),
        ("grant", "Mountain View", False, 7, 9, day, "4pm", 2026, True, False),
        ("grant", "Borah HS (ID)", False, 4, 5, day, None, 2026, False, True),
        ("mt_view", "Nowhere HS", True, 1, 0, day, None, 2026, False, False),
        ("grant", "Borah HS (ID)", True, 3, None, later, None, 2026, False, False)], SCHEDULE)
    got = rs.to_neutral(sched, aliases, teams)
    assert rows(got, "home_team_id", "away_team_id", "game_date", "venue_id", "home_score", "away_score", "status") == sorted([
        (1, 2, day, 11, 9, 7, "completed"), (6, 2, day, None, 5, 4, "completed"), (2, 6, later, 12, 3, None, "scheduled")], key=repr)
    assert rows(rv.unresolved(sched, "opponent", aliases, "game_date")) == [("Nowhere HS", 1, day, day)]
    # Loading again inserts nothing, loading the rest after an alias inserts the rest.
    assert got.count() == rs.reinsert_dropped(got, sched, aliases, teams).count()
    more = aliases.unionByName(spark.createDataFrame([(6, "Nowhere HS", "nowhere hs", "fix")], aliases.schema))
    assert rs.reinsert_dropped(got, sched, more, teams).count() == 4


def test_dropped_rows_are_inserted_without_computing_the_games_twice(spark, rows, teams, aliases, tmp_path):
    day = date(2026, 3, 16)
    sched = spark.createDataFrame([
        ("mt_view", "grant", True, 9, 7, day, "4pm", 2026, True, False), ("grant", "Mountain View", False, 7, 9, day, "4pm", 2026, True, False),
        ("mt_view", "Nowhere HS", True, 1, 0, day, None, 2026, False, False), ("mt_view", "Nowhere HS", True, 3, 0, None, None, 2026, False, False),
        ("grant", "mt_view", True, 3, 0, None, None, 2026, False, False)], SCHEDULE)
    rs.to_neutral(sched, aliases, teams).union(rs.to_neutral(sched, aliases, teams)).write.parquet(str(tmp_path / "games"))
    games = spark.read.parquet(str(tmp_path / "games"))
    more = aliases.unionByName(spark.createDataFrame([(6, "Nowhere HS", "nowhere hs", "fix")], aliases.schema))
    done = rs.reinsert_dropped(games, sched, more, teams)
    # The stored rows stay as they are, both copies; a row without a date matches nothing.
    assert rows(done, "home_team_id", "away_team_id", "game_date", "home_score") == sorted(
        2 * [(1, 2, day, 9), (2, 1, None, 3)] + [(1, 6, day, 1), (1, 6, None, 3), (2, 1, None, 3)], key=repr)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_names_resolve_alike_with_and_without_broadcast(spark, rows, aliases, limit):
    df = spark.createDataFrame([("grant",), (" MT. view ",), ("Nowhere HS",), (None,)], "raw string")
    marked = rv.at_hand(aliases, "alias_normalized", limit)
    assert ("ResolvedHint (strategy=broadcast)" in marked._jdf.queryExecution().analyzed().toString()) == (limit > 0)
    assert rows(rv.resolve(df, "raw", marked, how="left"), "raw", "resolved_id") == sorted(
        [("grant", 2), (" MT. view ", 1), ("Nowhere HS", None), (None, None)], key=repr)
    assert rv.at_hand(aliases.limit(0), "alias_normalized", limit).count() == 0


def test_scores_survive_both_conversions(spark, rows):
    g = spark.createDataFrame([(2026, 1, 2, date(2026, 3, 1), False, 5, 3, "completed"),
                               (2026, 2, 3, date(2026, 3, 2), False, None, None, "scheduled")], GAMES)
    p = rs.to_perspective(g)
    assert rows(p, "team_id", "opponent_id", "is_home", "my_score", "opp_score") == sorted(
        [(1, 2, True, 5, 3), (2, 1, False, 3, 5), (2, 3, True, None, None), (3, 2, False, None, None)], key=repr)


def test_prefer_or_unmatched(spark, rows):
    df = spark.createDataFrame([("a", "b", True), ("b", "a", False), ("c", "z", False)], "t string, o string, home boolean")
    assert rows(rv.prefer_or_unmatched(df, "home", ["o", "t"], ["t", "o"])) == [("a", "b", True), ("c", "z", False)]


def test_tie_is_neither_in_records_but_a_home_loss_in_ratings(spark, rows):
    g = spark.createDataFrame([(2026, 1, 2, date(2026, 3, 1), False, 4, 4, "completed")], GAMES)
    assert rows(rc.season_record(g)) == [(1, 2026, 0, 0), (2, 2026, 0, 0)]
    assert rows(rc.team_game_stats(g), "team_id", "wins", "losses") == [(1, 0, 1), (2, 1, 0)]


def test_refresh_keeps_teams_without_games(spark, rows):
    ts = spark.createDataFrame([(1, 2026, 0, 0, None), (9, 2026, 5, 5, None)],
                               "team_id long, season int, wins long, losses long, wl_computed_at timestamp_ntz")
    g = spark.createDataFrame([(2026, 1, 2, date(2026, 3, 1), False, 5, 4, "completed"),
                               (2026, 1, 2, date(2026, 3, 2), True, 5, 4, "completed")], GAMES)
    now = datetime(2026, 5, 1)
    got = rc.refresh_record(ts, rc.season_record(g), F.lit(now).cast("timestamp_ntz"))
    assert rows(got) == [(1, 2026, 1, 0, now), (9, 2026, 0, 0, now)]


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(2026, 1, 2, date(2026, 3, 1), False, 5, 3, "completed"),
                                  (2026, 2, 3, date(2026, 3, 2), False, 12, 0, "completed")], GAMES)


def test_ratings_golden(rows, chain):
    got = rt.rank(rt.power_ratings(chain), "rating", "team_id", ["season"])
    assert rows(got, "team_id", "rating", "agd", "sched", "rank", "wins", "losses") == [
        (1, 92.0, 2.0, 90.0, 3, 1, 0), (2, 96.0, 6.0, 90.0, 2, 1, 1), (3, 100.0, 10.0, 90.0, 1, 0, 1)]


def test_ratings_without_games_are_empty(chain):
    assert rt.power_ratings(chain.filter("season = 1")).count() == 0


def random_games(spark, n, teams, seed=5):
    rnd = random.Random(seed)
    data = set()
    while len(data) < n:
        # Team 0 plays in a third of all games.
        a = 0 if rnd.random() < 0.33 else rnd.randrange(teams)
        b = rnd.randrange(teams)
        if a != b:
            data.add((2020 + rnd.randrange(2), a, b, date(2020, 1 + rnd.randrange(12), 1 + rnd.randrange(28))))
    return spark.createDataFrame([(*k, False, rnd.randrange(20), rnd.randrange(20), "completed") for k in sorted(data)], GAMES)


def brute_ratings(games, passes=15):
    out = {}
    for season in {g[0] for g in games}:
        diffs, opps = {}, {}
        for _, h, a, _, _, hs, as_, _ in (g for g in games if g[0] == season):
            for me, other in ((h, a), (a, h)):
                diffs.setdefault(me, []).append(min(abs(hs - as_), 10))
                opps.setdefault(me, []).append(other)
        agd = {t: sum(d) / len(d) for t, d in diffs.items()}
        rating = dict(agd)
        for _ in range(passes):
            rating = {t: agd[t] + sum(rating[o] for o in opps[t]) / len(opps[t]) for t in agd}
        out.update({(season, t): round(r, 3) for t, r in rating.items()})
    return out


def test_every_rating_path_equals_brute_force(spark):
    g = random_games(spark, 600, 40)
    want = brute_ratings([tuple(r) for r in g.collect()])
    for options in ({}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "edges_per_task": 5}):
        got = {(r.season, r.team_id): round(r.rating, 3) for r in rt.power_ratings(g, **options).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 2e-3 for k in want), options


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}])
def test_a_pass_joins_opponents_not_pairs(spark, monkeypatch, options):
    """One stored row per opponent, also with more shuffle partitions than tasks; no pass moves these rows."""
    stored, lay = [], rt.durable_by
    monkeypatch.setattr(rt, "durable_by", lambda *a, **k: stored.append(lay(*a, **k)) or stored[-1])
    g = random_games(spark, 300, 20)
    slots = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(2 * spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = rt.power_ratings(g, passes=2, **options)
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {(r.season, r.team_id): round(r.rating, 3) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", slots)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = brute_ratings([tuple(r) for r in g.collect()], 2)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-3 for k in want)
    edges = stored[0]
    assert edges.count() == len(want) == edges.select("season", "opponent_id").distinct().count()
    lines = plan.splitlines()
    moved = [b for a, b in zip(lines, lines[1:]) if "Exchange" in a and "_teams" in b]
    assert not moved


def test_pairs_are_not_moved_again_in_a_pass(spark):
    g = random_games(spark, 200, 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = rt.power_ratings(g, passes=3, broadcast_limit=0)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange of partial sums per pass, the first ratings, and the final join's two sides.
    assert plan.count("Exchange hashpartitioning") <= 3 + 2
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_ranks_equal_window_ranks(spark, rows):
    df = spark.createDataFrame([(i % 2, i, i * 7 % 5) for i in range(200)], "season int, team_id long, wins long")
    w = W.partitionBy("season").orderBy(F.desc("wins"))
    for tie, fn in (("rank", F.rank()), ("dense_rank", F.dense_rank())):
        got = rt.rank(df, "wins", "team_id", ["season"], tie=tie)
        assert rows(got, "season", "team_id", "rank") == rows(df.withColumn("rank", fn.over(w)), "season", "team_id", "rank")
    numbered = number_rows(df.repartition(7), [F.col("wins").desc(), F.col("team_id")], out="n")
    assert [r.n for r in numbered.orderBy("n").collect()] == list(range(1, 201))


def test_chunked_windows_equal_plain_windows(spark, rows):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", i, rnd.choice([None, "a", "b"])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, v string")
    w = W.partitionBy("k").orderBy("i")
    block = F.floor(F.col("i") / 13)
    assert rows(previous_value(df, F.col("v"), ["k"], ["i"], block, "p")) == rows(df.withColumn("p", F.lag("v").over(w)))
    assert rows(last_value_so_far(df, F.col("v"), ["k"], ["i"], block, "p")) == rows(
        df.withColumn("p", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0))))


def test_snapshot_hash_ignores_order_and_sees_content(spark):
    schema = ("source string, season int, captured_at timestamp_ntz, team_name string, rank_position int, rating double, "
              "agd double, sched double, record_wins int, record_losses int")
    t = datetime(2026, 3, 1)
    data = [("laxpower", 2026, t, f"T{i}", i, i * 1.5, None, 0.5, i, 1) for i in range(20)]
    digest = lambda d: rt.snapshots(spark.createDataFrame(d, schema).repartition(5)).first()["content_hash"]
    assert digest(data) == digest(list(reversed(data)))
    changed = [*data[:-1], (*data[-1][:-1], 2)]
    assert digest(data) != digest(changed) and len(digest(data)) == 64


def test_entries_of_two_snapshots_of_one_day_do_not_multiply(spark):
    hist = spark.createDataFrame(
        [("laxpower", 2026, datetime(2026, 3, 1, h), "T1", 1, 1.0, 1.0, 1.0, 1, 1) for h in (8, 20)],
        "source string, season int, captured_at timestamp_ntz, team_name string, rank_position int, rating double, "
        "agd double, sched double, record_wins int, record_losses int")
    aliases = spark.createDataFrame([(1, "t1")], "team_id long, alias_normalized string")
    assert rt.entries(hist, rt.snapshots(hist), aliases).count() == 2


def test_canonical_pick_and_conflict(spark, rows):
    rec = spark.createDataFrame([(1, "laxpower", 1, 2), (1, "ohsla", 3, 4), (2, "laxpower", 5, 5), (2, "ohsla", None, None)],
                                "game_id long, source string, home_score int, away_score int")
    pr = spark.createDataFrame([("ohsla", 100), ("laxpower", 0)], "source string, priority int")
    assert rows(rt.pick_canonical(rec, pr), "game_id", "home_score", "canonical_source", "has_conflict") == [
        (1, 3, "ohsla", True), (2, None, "ohsla", False)]
