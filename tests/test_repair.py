from datetime import date

from scorebook.operators import repair, reshape
from scorebook.schemas import TABLES
from scorebook.session import joins_by_layout
from scorebook.sources import layout

DAY = date(2026, 4, 1)
NAMES = {1: "ash", 2: "birch", 3: "cedar", 4: "dogwood", 5: "elm"}


def row(me, opp, is_home, own, other, day=1, season=2026):
    return (me, DAY.replace(day=day) if day else None, None, opp, is_home, False, None, own, other, False, season, None)


def setup(spark, data, known=NAMES):
    teams = spark.createDataFrame([(t, n, n.title(), None, None, None) for t, n in NAMES.items()], TABLES["teams"])
    aliases = spark.createDataFrame([(t, n, n, "seed") for t, n in known.items()], TABLES["team_aliases"])
    schedule = spark.createDataFrame(data, TABLES["schedule"])
    return reshape.to_neutral(schedule, aliases, teams), schedule, aliases, teams


def test_rounds_build_on_each_other(spark, rows):
    # "The Birches" is told by round one, only then the row it stands in tells "Ash HS"; that then tells "Cedars".
    data = [row("ash", " The Birches ", True, 7, 3), row("birch", "ash", False, 3, 7),
            row("cedar", "The Birches", True, 5, 4, 2), row("The  Birches", "cedar", False, 4, 5, 2),
            row("ash", "The Birches", True, 9, 1, 3), row("birch", "Ash HS", False, 1, 9, 3),
            row("cedar", "Ash HS", True, 2, 1, 4), row("ash", "Cedars", False, 1, 2, 4)]
    games, schedule, aliases, teams = setup(spark, data)
    done = repair.repair_rounds(games, schedule, aliases, teams)
    assert rows(done.added, "round", "alias_normalized", "team_id", "evidence") == [
        (1, "the birches", 2, 1), (2, "ash hs", 1, 1), (2, "the  birches", 2, 1), (3, "cedars", 3, 1)]
    assert not rows(done.open)
    assert done.games.count() == 4 and rows(done.games, "home_team_id", "away_team_id", "home_score") == [(1, 2, 7), (1, 2, 9), (3, 1, 2), (3, 2, 5)]
    assert done.aliases.count() == len(NAMES) + 4


def test_evidence_for_two_teams_is_never_used(spark, rows):
    data = [row("ash", "Forest", True, 7, 3), row("birch", "ash", False, 3, 7),
            row("cedar", "Forest", True, 6, 2, 2), row("dogwood", "cedar", False, 2, 6, 2)]
    done = repair.repair_rounds(*setup(spark, data))
    assert not rows(done.added)
    assert rows(done.open, "alias_normalized", "occurrences", "candidates") == [("forest", 2, 2)]


def test_what_is_no_evidence(spark, rows):
    data = [row("ash", "No Score", True, None, None), row("birch", "ash", False, None, None),     # nothing to compare
            row("ash", "No Day", True, 7, 3, None), row("birch", "ash", False, 3, 7, None),
            row("ash", "Same Side", True, 8, 1, 5), row("birch", "ash", True, 1, 8, 5),           # both at home
            row("ash", "Other Score", True, 8, 2, 6), row("birch", "ash", False, 3, 8, 6),
            row("ash", "Other Season", True, 8, 2, 7, 2025), row("birch", "ash", False, 2, 8, 7),
            row("ash", "", True, 4, 2, 8), row("birch", "ash", False, 2, 4, 8),                   # no name
            row("ash", None, True, 4, 2, 9), row("birch", "ash", False, 2, 4, 9),
            row("Nobody", "No One", True, 1, 0, 10)]                                              # neither side known
    games, schedule, aliases, teams = setup(spark, data)
    done = repair.repair_rounds(games, schedule, aliases, teams)
    assert not rows(done.added) and rows(done.games) == rows(games)
    assert {r.alias_normalized for r in done.open.collect()} == {
        "no score", "no day", "same side", "other score", "other season", "", None, "nobody", "no one"}


def test_repeated_rows_and_empty_tables(spark, rows):
    data = 3 * [row("ash", "Elms", False, 2, 6)] + 2 * [row("elm", "ash", True, 6, 2)]
    done = repair.repair_rounds(*setup(spark, data))
    assert rows(done.added) == [(1, "elms", 5, 1)] and done.games.count() == 1
    done = repair.repair_rounds(*setup(spark, []))
    assert not rows(done.added) and not rows(done.open) and not rows(done.games)


def test_rows_meet_their_mirrors_without_a_shuffle(spark, rows, tmp_path):
    columns = "season int, _day date, _home_score int, _away_score int, is_home boolean, _me string, _opp string, _me_id long, _opp_id long, _group int"
    data = [(2026, DAY, 2, 6, True, None, "elms", 1, None, 7), (2026, DAY, 2, 6, False, None, None, 5, 1, 7)]
    stored = layout.deal_bucketed(spark.createDataFrame(data, columns), "repair_mirrors", str(tmp_path / "rows"), 3, ["_group"])
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before, threshold = spark.conf.get(name), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joins_by_layout(spark):
            found = repair._evidence(stored)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert rows(found) == [("elms", 5, 1, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        layout.drop_bucketed(spark, "repair_mirrors")
    # What is shuffled is found evidence by name; the join itself moves nothing.
    assert "SortMergeJoin" in plan and "Exchange" not in plan[plan.index("SortMergeJoin"):]
    assert spark.conf.get(name) == before


def test_rows_that_are_no_evidence_count_as_open(spark, rows):
    # Both names open, one open beside each known team, repeated rows, rows without a day, side or score.
    data = [row("Elms", "Oaks", True, 2, 6)] * 3 + [row("ash", "Oaks", True, 1, 0, None), row("birch", "Oaks", None, 1, 0), row("ash", "Oaks", True, None, 0),
            row("ash", "birch", True, None, None), row("elm", "Elms", True, 5, 1, 2), row("Elms", "elm", False, 1, 5, 2)]
    games, schedule, aliases, teams = setup(spark, data)
    for buckets in (1, 5):
        done = repair.repair_rounds(games, schedule, aliases, teams, buckets)
        assert not rows(done.added)
        assert rows(done.open, "alias_normalized", "occurrences", "candidates") == [("elms", 5, 0), ("oaks", 6, 0)]


def test_rounds_store_little(spark):
    """The rounds keep what they find for each name, not the rows they go over."""
    data = [r for i in range(2000) for r in (row("ash", "Birches", True, i % 40, i // 40, 1 + i % 28), row("birch", "ash", False, i // 40, i % 40, 1 + i % 28))]
    games, schedule, aliases, teams = setup(spark, data)
    kept = []
    whole, repair.durable = repair.durable, lambda df: kept.append(whole(df)) or kept[-1]
    try:
        done = repair.repair_rounds(games, schedule, aliases, teams)
        assert done.added.count() == 1 and done.games.count() == 28
    finally:
        repair.durable = whole
    assert kept and all(df.count() <= 1 for df in kept)
