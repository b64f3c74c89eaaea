import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, journal, resolve
from tidemark.plans import fixtures
from tidemark.plans.params import Params

POSITIVE = [
    ("Sam Carter (ankle) ruled out for Week 4.", ("out", "ruled_out", ["Sam Carter"], None, ["ankle"], None, 4, False)),
    ("Reporter: Bears WR Lou Hart (hip) doubtful for Week 2.", ("doubtful", "doubtful", ["Lou Hart"], "Bears", ["hip"], "Reporter", 2, False)),
    ("Status alert: Max Stone (knee) won't return Sunday.", ("in_game_injury", "in_game_8", ["Max Stone"], None, ["knee"], None, None, False)),
    ("Packers RB Al Reed (toe), TE Bo Lind (rib) and QB Cy Moon questionable for preseason Week 1", ("questionable", "questionable", ["Al Reed", "Bo Lind", "Cy Moon"], "Packers", ["toe", "rib", None], None, 1, True)),
    ("Ed Fox traded to the Bucs.", ("transaction", "transaction_2", ["Ed Fox"], "Buccaneers", [None], None, None, False)),
    ("Jo Day suffered torn ACL.", ("out", "season_ending_injury", ["Jo Day"], None, [None], None, None, False)),
    ("Jo Day carted off field with apparent leg injury", ("in_game_injury", "in_game_any_0", ["Jo Day"], None, [None], None, None, False)),
    ("Jo Day (leg) healthy scratch for Week 11.", ("inactive", "healthy_inactive", ["Jo Day"], None, ["leg"], None, 11, False)),
]
UNKNOWN = ["Ann's view: Jo Park could return soon.", "Jo Day (knee) seen participating in practice Friday.", "", "Welcome, Jo Day.", "Jo Day could be out for Week 3 or not", "Rams hopeful Jo Day (hip) plays Week 3."]


def test_templates(spark):
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(POSITIVE)] + [(100 + n, t) for n, t in enumerate(UNKNOWN)] + [(999, None)], "post_id bigint, text string")
    got = {r["post_id"]: r["c"] for r in rows.select("post_id", classify.classification(rows["text"]).alias("c")).collect()}
    for n, (_, want) in enumerate(POSITIVE):
        c = got[n]
        assert (c["status"], c["template"], c["players"], c["team"], c["injuries"], c["source"], c["week"], c["preseason"]) == want
    assert all(c["status"] == "unknown" for k, c in got.items() if k >= 100)
    stored = {r["post_id"]: r for r in classify.classify_posts(rows, "v1").collect()}
    assert stored[100]["players"] is None and stored[100]["detail"] is None and stored[0]["detail"]["week"] == 4


def test_resolution_ladder(spark):
    got = {(r["post_id"], r["subject"]): r for r in resolve.resolve(fixtures.subjects(spark), fixtures.games(spark), fixtures.markets(spark), Params()).collect()}
    one = got[1, "Lou Hart"]
    assert (one["status"], one["event_id"], one["team"], one["tier1"], one["reason"]) == ("matched", "g2", "Bears", True, "team from prop history")
    assert one["market_ids"] == [m[0] for m in [(r["market_id"],) for r in fixtures.markets(spark).collect()] if m[0].endswith(("2", "3"))]
    assert got[2, "Lou Hart"]["status"] == "ambiguous" and "post says Vikings" in got[2, "Lou Hart"]["reason"]
    assert got[3, "No Body"]["status"] == "unmatched" and got[3, "Dan Wolf"]["status"] == "ambiguous"
    assert got[4, "No Body"]["status"] == "team_only" and got[4, "No Body"]["reason"].endswith("no props for player in this game")
    assert got[5, "Lou Hart"]["status"] == "unmatched" and got[5, "Lou Hart"]["team"] == "Bears"
    roster = spark.createDataFrame([("dan wolf", ["Lions"])], "name string, teams array<string>")
    tied = {(r["post_id"], r["subject"]): r for r in resolve.resolve(fixtures.subjects(spark), fixtures.games(spark), fixtures.markets(spark), Params(), roster).collect()}
    assert tied[3, "Dan Wolf"]["team"] == "Lions" and tied[3, "Dan Wolf"]["status"] == "matched"
    traded = spark.createDataFrame([(one["market_ids"][1],)], "market_id string")
    kept = {(r["post_id"], r["subject"]): r["market_ids"] for r in resolve.traded_only(resolve.resolve(fixtures.subjects(spark), fixtures.games(spark), fixtures.markets(spark), Params()), traded).collect()}
    assert kept[1, "Lou Hart"] == one["market_ids"][1:] and kept[2, "Lou Hart"] is None


def test_recent_team_stays_settled(spark):
    rows = [([["A", "B"], ["A", "C"], ["B", "D"]], ["A"]), ([["A", "B"], ["C", "D"], ["A", "D"]], ["A", "B"]), ([["A", "B"], ["B", "A"]], ["A", "B"]), ([["A", "B"]], ["A", "B"]), ([], None)]
    df = spark.createDataFrame(rows, "g array<array<string>>, want array<string>")
    for r in df.select(resolve.recent_team(df["g"]).alias("got"), "want").collect():
        assert r["got"] == r["want"]


SEQUENCE = [("snapshot", 10), ("delta", 11), ("delta", 11), ("delta", 13), ("delta", 14), ("snapshot", 20), ("delta", 21)]
RESULTS = ["snapshot", "ok", "duplicate", "gap", "resyncing", "resynced", "ok"]


def test_sequence_tracker(spark):
    rows = [("c", "m", n, "book", k, s) for n, (k, s) in enumerate(SEQUENCE)] + [("c", "new", 0, "book", "delta", 1), ("c", "new", 1, "book", "delta", 3), ("c", "new", 2, "life", "snapshot", 5), ("c", "new", 3, "book", "drop", None)]
    got = journal.sequence_results(spark.createDataFrame(rows, "conn string, market string, line bigint, channel string, kind string, seq bigint")).orderBy("line").collect()
    assert [r["result"] for r in got if r["market"] == "m"] == RESULTS
    assert [r["result"] for r in got if r["market"] == "new"] == ["ok", "gap", "resynced", "dropped"]


def test_sequence_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "conn string, market string, line bigint, channel string, kind string, seq bigint"
    for part in (SEQUENCE[:4], SEQUENCE[4:]):
        at = SEQUENCE.index(part[0])
        spark.createDataFrame([("c", "m", at + n, "book", k, s) for n, (k, s) in enumerate(part)], schema).coalesce(1).write.mode("append").json(str(src))
    from tidemark.streaming import jobs

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = jobs.sequence_stream(stream).writeStream.format("memory").queryName("seq_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["result"] for r in spark.table("seq_test").orderBy("line").collect()] == RESULTS


def ev(ts, kind, **kw):
    return {"ts": ts, "kind": kind, **kw}


@pytest.mark.parametrize(
    ("log", "want"),
    [
        ([ev(1, "start", slots=1), ev(5, "covered", slot=0)], [(1, 5, "all", "not running")]),
        ([ev(1, "start", slots=2), ev(2, "covered", slot=0, events=["a"]), ev(3, "covered", slot=1), ev(7, "disconnected", slot=0), ev(9, "covered", slot=0)], [(1, 3, "all", "not running"), (7, 9, "connection", "disconnected")]),
        ([ev(1, "start", slots=1), ev(2, "covered", slot=0), ev(6, "heartbeat"), ev(20, "start", slots=1), ev(25, "covered", slot=0)], [(1, 2, "all", "not running"), (6, 25, "all", "crash")]),
        ([ev(1, "start", slots=1), ev(2, "covered", slot=0), ev(4, "seq_gap", slot=0, market="m"), ev(6, "disconnected", slot=0), ev(8, "stop", detail="disk")], [(1, 2, "all", "not running"), (6, None, "all", "disk")]),
        ([ev(1, "start", slots=1), ev(2, "covered", slot=0), ev(4, "seq_gap", slot=0, market="m")], [(1, 2, "all", "not running"), (4, None, "market", "seq gap")]),
    ],
)
def test_coverage(spark, log, want):
    lines = [("p", n, *(e.get(c) for c in ("ts", "kind", "slot", "slots", "events", "market", "detail"))) for n, e in enumerate(log)]
    rows = spark.createDataFrame(lines, "env string, line int, ts bigint, kind string, slot int, slots int, events array<string>, market string, detail string")
    assert [(w["start"], w["end"], w["scope"], w["cause"]) for w in journal.missing_windows(rows).orderBy("start").collect()] == want


def test_missing_windows_and_slots(spark):
    got = journal.missing_windows(fixtures.journal(spark)).orderBy("start").collect()
    assert [(r["start"], r["end"], r["scope"]) for r in got] == [(1000, 1200, "all"), (1300, 1400, "market"), (1500, 1600, "connection"), (1800, None, "all")]
    rows = [("p", f"e{n}", n, m, None) for n, m in ((1, 1500), (2, 1000), (3, 700), (4, 600), (5, 1700))]
    plan = {r["eventId"]: r["slot"] for r in journal.plan_slots(spark.createDataFrame(rows, "env string, eventId string, startsTs bigint, markets bigint, current_slot int"), 2, 1800).collect()}
    assert plan == {"e1": 0, "e2": 1, "e3": 1, "e4": None, "e5": None}
    assert journal.pack_slots([("a", 5, 1), ("b", 5, None)], 2, 10) == [("a", 1), ("b", 0)]


def test_hourly_landing(spark, tmp_path):
    from tidemark.streaming import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"recv_ts": 3600000, "conn": "c", "msg": {"snapshot": {"m": {"eventId": "e", "book": {"seq": 4}}}}}\n{"recv_ts": 7200001, "conn": "c", "msg": {"delta": {"m": {"eventId": "e", "book": {"seq": 5}, "lifecycle": {"seq": 1}}}}, "unknown": [1,  2]}\n')
    jobs.write_hourly(jobs.landed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(p.name for p in (tmp_path / "out").glob("date=*/*")) == ["hour=01", "hour=02"]
    kept = [x for p in (tmp_path / "out").glob("date=*/hour=*/*.txt") for x in p.read_text().splitlines()]
    assert sorted(kept) == sorted((tmp_path / "in" / "a.jsonl").read_text().splitlines())
    from tidemark.sources import files

    got = files.channels(files.stream_files(spark, str(tmp_path / "in"))).collect()
    assert sorted((r["kind"], r["channel"], r["seq"]) for r in got) == [("delta", "book", 5), ("delta", "lifecycle", 1), ("snapshot", "book", 4)]


def test_messages_in_their_order(spark):
    from tidemark import schemas
    from tidemark.sources import files

    body = '{"m": {"eventId": "e", "book": {"seq": 4}}}'
    lines = [(f'{{"recv_ts": 1, "conn": "c", "msg": {{"delta": {body}, "nonce": 7, "snapshot": {body}}}}}',)]
    rows = spark.createDataFrame(lines, "v string").select(F.from_json("v", schemas.STREAM).alias("r")).select("r.*")
    assert [(r["kind"], r["seq"], r["nonce"]) for r in files.messages(rows).orderBy("recv_ts", "turn").collect()] == [("snapshot", 4, None), ("ack", None, 7), ("delta", 4, None)]


def test_resolutions_are_replaced_by_the_first(spark):
    from tidemark.operators import tables

    schema = "post_id bigint, model_version string, subject string, status string, reason string, event_id string, resolved_at int"
    old = spark.createDataFrame([(1, "a", "s", "old", "", "e", 0), (1, "b", "s", "other", "", "e", 0)], schema)
    new = spark.createDataFrame([(1, "a", "s", "late", "", "e", 2), (1, "a", "s", "early", "", "f", 1), (1, "a", "s", "early too", "", "g", 1)], schema)
    assert sorted(r["status"] for r in tables.replace_resolutions(old, new, "a").collect()) == ["early", "other"]


def test_manifest_of_archived_files(spark):
    from tidemark.operators import tables

    files = spark.createDataFrame([("/x/2024/a.tar.gz", 3), ("/x/b.tar.gz", 5), ("/y/b.tar.gz", 4)], "path string, size bigint")
    assert {tuple(r) for r in tables.manifest(files).collect()} == {("a.tar.gz", 3), ("b.tar.gz", 5)}


def test_sides_of_fixtures(spark):
    from tidemark.operators import sides

    rows = sides.favored_side(fixtures.moments(spark).join(fixtures.side_markets(spark))).select("subject", "market_id", "status", "kind", "favored_id").collect()
    got = {(r["subject"], r["status"], r["market_id"]): (r["kind"], r["favored_id"]) for r in rows}
    assert got["Lou Hart", "doubtful", "m1"] == ("player_prop", "o2") and got["Lou Hart", "out", "m1"] == ("player_prop", None)
    assert got["Lou Hart", "doubtful", "m2"] == ("game_line", "o3") and got["Lou Hart", "doubtful", "m4"][1] is None
    assert got["Lou Hart", "doubtful", "m5"] == ("team_total", "o10") and got["Lou Hart", "doubtful", "m6"][1] is None


def test_windows_and_slots_of_whole_tables(spark):
    from tidemark.plans import registry

    where = "/root/testdata/sf0.01"
    changes = []
    known = {}
    for r in registry.event_journal(spark, where).orderBy("line").collect():
        changes += [{"env": r["env"], **x} for x in known.setdefault(r["env"], journal.Coverage()).take(*r[1:])]
    names = [c.split()[0] for c in journal.CHANGES.split(", ")]
    want = journal.current_windows(spark.createDataFrame([tuple(x.get(c) for c in names) for x in changes], journal.CHANGES)).collect()
    got = registry.QUERIES["missing_windows"](spark, where).collect()
    plain = lambda rows: sorted(((r["env"], r["start"], r["end"], r["scope"], r["slot"], r["events"] or None, r["market"], r["cause"]) for r in rows), key=str)
    assert plain(got) == plain(want) and len(got) > 500
    held = {}
    for r in spark.read.parquet(f"{where}/customer.parquet").collect():
        held.setdefault(f"env{r['c_nationkey']}", []).append((r["c_name"], r["c_custkey"], r["c_nationkey"] * 40))
    plan = {(e, n): s for e, rows in held.items() for n, s in journal.pack_slots([(n, m, None) for n, _, m in sorted(rows, key=lambda x: (x[1], x[0]))], 4, 1800)}
    assert {(r["env"], r["eventId"]): r["slot"] for r in registry.QUERIES["plan_slots"](spark, where).collect()} == plan
