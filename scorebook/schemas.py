"""Table shapes, keys, references and value domains of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_FIELD = {
    "int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "bool": T.BooleanType(),
    "double": T.DoubleType(), "date": T.DateType(), "ts": T.TimestampNTZType(),
    "dec3": T.DecimalType(8, 3), "dec2": T.DecimalType(8, 2),
}


def _schema(text: str) -> T.StructType:
    fields = (item.split() for item in text.split(","))
    return T.StructType([T.StructField(name, _FIELD[kind]) for name, kind in fields])


RANKING_PAYLOAD = _schema("ranking int, name string, wins int, losses int, rating double, agd double, sched double")
RAW_PAGES = _schema("page_id long, url string, html string")

TABLES: dict[str, T.StructType] = {
    "rankings": _schema(
        "season int, rank_position int, team_name string, record string, wins int, losses int, "
        "rating dec3, agd dec3, sched dec3, scraped_at ts"),
    "rankings_consensus": _schema(
        "season int, rank_position int, team_name string, record string, wins int, losses int, "
        "consensus dec3, scraped_at ts"),
    "schedule": _schema(
        "team_id string, game_date date, game_time string, opponent string, is_home bool, is_conference bool, "
        "result string, team_score int, opp_score int, is_ot bool, season int, scraped_at ts"),
    "run_log": _schema("source string, teams_scraped long, status string, error_message string, scraped_at ts"),
    "teams": _schema("team_id long, slug string, name string, city string, state string, home_venue_id long"),
    "venues": _schema("venue_id long, name string, city string, state string, lat double, lon double"),
    "team_aliases": _schema("team_id long, alias string, alias_normalized string, source string"),
    "team_seasons": _schema("team_id long, season int, conference string, wins long, losses long, wl_computed_at ts"),
    "team_coaches": _schema("team_id long, coach_id long, season int, role string, source string"),
    "games": _schema(
        "season int, home_team_id long, away_team_id long, game_date date, game_datetime ts, venue_id long, "
        "is_conference bool, is_overtime bool, is_scrimmage bool, home_score int, away_score int, status string, "
        "canonical_source string, has_conflict bool"),
    "game_source_priority": _schema("source string, priority int"),
    "game_source_records": _schema(
        "game_id string, source string, home_team_raw string, away_team_raw string, home_score int, "
        "away_score int, scraped_at ts"),
    "unresolved_aliases": _schema(
        "raw_name string, source string, first_seen_at ts, last_seen_at ts, occurrence_count long, "
        "resolved_team_id long"),
    "rankings_snapshots": _schema("source string, season int, captured_at ts, content_hash string"),
    "ranking_entries": _schema(
        "source string, season int, captured_at ts, team_id long, rank_position int, rating dec2, agd dec2, "
        "sched dec2, record_wins int, record_losses int"),
    "live_reports": _schema(
        "event_id long, ts ts, reporter_id long, game_id long, home_score int, away_score int, game_state string"),
}

# Natural keys: what an upsert matches on and what the key audit checks.
KEYS: dict[str, list[str]] = {
    "rankings": ["season", "rank_position"],
    "rankings_consensus": ["season", "rank_position"],
    "schedule": ["team_id", "game_date", "opponent", "game_time"],
    "teams": ["slug"],
    "venues": ["name", "city"],
    "team_aliases": ["alias_normalized"],
    "team_seasons": ["team_id", "season"],
    "team_coaches": ["team_id", "coach_id", "role", "season"],
    "games": ["season", "home_team_id", "away_team_id", "game_date"],
    "game_source_priority": ["source"],
    "game_source_records": ["game_id", "source"],
    "unresolved_aliases": ["raw_name", "source"],
    "rankings_snapshots": ["source", "season", "captured_at"],
    "ranking_entries": ["source", "season", "captured_at", "team_id"],
    "live_scores": ["game_id"],
}

# (child table, child columns, parent table, parent columns, what a parent delete does)
REFERENCES = [
    ("teams", "home_venue_id", "venues", "venue_id", "set_null"),
    ("team_aliases", "team_id", "teams", "team_id", "cascade"),
    ("team_seasons", "team_id", "teams", "team_id", "cascade"),
    ("team_coaches", "team_id", "teams", "team_id", "cascade"),
    ("team_coaches", "coach_id", "coaches", "coach_id", "restrict"),
    ("games", "home_team_id", "teams", "team_id", "restrict"),
    ("games", "away_team_id", "teams", "team_id", "restrict"),
    ("games", "venue_id", "venues", "venue_id", "set_null"),
    ("games", "canonical_source", "game_source_priority", "source", "restrict"),
    ("game_source_records", "game_id", "games", "game_id", "cascade"),
    ("unresolved_aliases", "resolved_team_id", "teams", "team_id", "set_null"),
    ("ranking_entries", "team_id", "teams", "team_id", "restrict"),
    ("ranking_entries", "source,season,captured_at", "rankings_snapshots", "source,season,captured_at", "cascade"),
]

# --- Fixed values: columns an upsert overwrites, legal enum values, source priorities.
UPDATE_COLUMNS = {
    "rankings": ["team_name", "record", "wins", "losses", "rating", "agd", "sched", "scraped_at"],
    "rankings_consensus": ["team_name", "record", "wins", "losses", "consensus", "scraped_at"],
    "schedule": ["game_time", "is_home", "is_conference", "result", "team_score", "opp_score", "is_ot", "scraped_at"],
}
GAME_STATUS = ["scheduled", "completed", "cancelled", "postponed"]
COACH_ROLE = ["head", "assistant"]
SNAPSHOT_SOURCE = ["laxnumbers", "laxpower"]
GAME_STATE = ["pregame", "q1", "q2", "halftime", "q3", "q4", "overtime", "final"]
SOURCE_PRIORITY = [("ohsla", 100), ("laxnumbers", 50), ("laxpower", 0)]
SMALLINT_UNSIGNED = (0, 65535)
TINYINT_UNSIGNED = (0, 255)
DEFAULT_SEASON = 2026
PLACEHOLDER_OPPONENT = "Team Place Holder"
PLAYOFF_START = "2026-05-14"
# --- End of fixed values.
