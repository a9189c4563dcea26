"""Files: archives, JSON pages, sidecars, records, windows, stored bars and snapshots."""

import datetime as dt
import gzip
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tapeledger.operators import bars, experiments
from tapeledger.sources import bar_store, candles, catalog, kline, records, snapshots

T0 = dt.datetime(2024, 1, 1)
MS0 = 1704067200000
HEADER = ",".join(kline.KLINE_COLUMNS)


def csv_line(hour, close=10.0, volume=5.0, count=3):
    t = MS0 + hour * 3_600_000
    return f"{t},10.0,{max(11.0, close)},9.0,{close},{volume},{t + 3_599_999},0,{count},0,0,0"


def archive(folder, name, lines, digest=None, named=None):
    path = folder / f"{name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"{name}.csv", "\n".join(lines) + "\n")
    sha = digest or hashlib.sha256(path.read_bytes()).hexdigest()
    (folder / f"{name}.zip.CHECKSUM").write_text(f"{sha}  {named or name + '.zip'}\n")


@pytest.fixture
def mapping(spark):
    return spark.createDataFrame([("BTC", "BTCUSDT", "mapped"), ("NONE", None, "unmatched")], "symbol string, venue_symbol string, status string")


def test_archives(spark, tmp_path, mapping):
    archive(tmp_path, "BTCUSDT-1h-2024-01", [HEADER, csv_line(0, volume=0.0, count=0), csv_line(1), csv_line(2), csv_line(3)])
    archive(tmp_path, "BTCUSDT-1h-2024-02", [csv_line(3), csv_line(4)])  # no header; the first row repeats the file before
    archive(tmp_path, "BTCUSDT-1h-2024-03", [csv_line(4, close=11.0), csv_line(5)], digest="0" * 64)
    archive(tmp_path, "BTCUSDT-1h-2024-04", [csv_line(6)], named="other.zip")
    a = kline.read_archives(spark, str(tmp_path))
    status = kline.checksum_audit(a, kline.read_sidecars(spark, str(tmp_path)))
    assert {r.file.rsplit("/", 1)[-1][-6:-4]: r.checksum_status for r in status.collect()} == {"01": "OK", "02": "OK", "03": "MISMATCH", "04": "WRONG_NAME"}
    parsed = kline.parse_lines(kline.archive_lines(a))
    b, conflicts, findings = kline.normalise_klines(parsed, mapping)
    hours = [(r.timestamp - T0).total_seconds() / 3600 for r in b.orderBy("timestamp").collect()]
    assert hours == [1, 2, 3, 5, 6] and b.first().symbol == "BTC"  # untraded start dropped, hour 4 is a conflict
    assert [r.n_rows for r in conflicts.collect()] == [2] and findings.count() == 0
    assert sorted(r.n_rows for r in kline.file_manifest(parsed).collect()) == [1, 2, 2, 4]
    e = kline.size_estimate(a, F.lit(50.0), limit_gb=5.0).first()
    assert (e.n_files, e.n_rows, e.within_limit) == (4, 2920, True)
    with pytest.raises(ValueError):
        kline.require_within_limit(kline.size_estimate(a, F.lit(1e9), limit_gb=5.0))


def test_lines_that_cannot_be_used(spark, mapping):
    lines = spark.createDataFrame([("f/BTCUSDT-1h-2024-01.zip", 0, "open time,x"), ("f/BTCUSDT-1h-2024-01.zip", 1, csv_line(1)), ("f/BTCUSDT-1h-2024-01.zip", 2, "1,2,3"), ("f/BTCUSDT-1h-2024-01.zip", 3, csv_line(2, close=-1.0)), ("f/BTCUSDT-1h-2024-01.zip", 4, "")], "file string, line_no bigint, line string")
    parsed = kline.parse_lines(lines)
    assert rows(parsed.where("error is not null").select("line_no", "error"), "line_no") == [(0, "UNKNOWN_FIRST_LINE"), (2, "TOO_FEW_FIELDS")]
    _, _, findings = kline.normalise_klines(parsed, mapping)
    assert {r.code for r in findings.collect()} >= {"MALFORMED_OHLC:close", "UNKNOWN_FIRST_LINE", "TOO_FEW_FIELDS"}


def raw_candle(hour, close="10.5", shift=0, volume="1.5"):
    t = MS0 + hour * 3_600_000
    return {"t": t, "T": t + 3_599_999 + shift, "s": "BTC", "i": "1h", "o": "10", "h": "11", "l": "9", "c": close, "v": volume, "n": 4}


def test_candle_pages_as_gzip(spark, tmp_path):
    for i, page in enumerate([[raw_candle(0), raw_candle(1)], [raw_candle(1), raw_candle(2, shift=1)], [raw_candle(2, close="10.6", shift=1)]]):
        with gzip.open(tmp_path / f"{i}.json.gz", "wt") as f:
            json.dump(page, f)
    b, conflicts, findings = candles.normalise_candles(candles.read_pages(spark, str(tmp_path)))
    assert [(r.timestamp, r.close, r.trade_count) for r in b.orderBy("timestamp").collect()] == [(T0, 10.5, 4), (T0 + dt.timedelta(hours=1), 10.5, 4)]
    assert [r.n_rows for r in conflicts.collect()] == [2] and {r.code for r in findings.collect()} == {"BAD_CLOSE_TIME"}
    out = str(tmp_path / "copy")
    candles.write_pages(candles.read_pages(spark, str(tmp_path / "*.gz")), out)
    assert candles.read_pages(spark, out).count() == 3


def test_wrong_close_times_of_bars_with_a_price_of_zero(spark, tmp_path):
    from tapeledger.plans import catalogue
    from tools.compare import connect, difference

    ticks = [(1, T0, 1, "X", 10.0, '{"k": 1}'), (2, T0 + dt.timedelta(minutes=1), 1, "X", 0.0, '{"k": 1}'), (3, T0 + dt.timedelta(minutes=2), 1, "X", 71.0, '{"k": 1}')]
    spark.createDataFrame(ticks, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = catalogue.QUERIES["candle_findings"](spark, str(tmp_path)).toPandas()
    assert len(got) == 1 and difference(got, connect(str(tmp_path)).execute(catalogue.ORACLES["candle_findings"]).fetch_df()) is None
    zero = json.dumps([raw_candle(0) | {"l": "0.0"}])  # the operator still reports the price
    _, _, findings = candles.normalise_candles(spark.createDataFrame([(zero,)], "value string"))
    assert [r.code for r in findings.collect()] == ["MALFORMED_OHLC:low"]


def test_funding_keeps_milliseconds_and_universe_keeps_positions(spark):
    f = candles.parse_funding(spark.createDataFrame([('[{"coin":"BTC","fundingRate":"0.0000125","premium":null,"time":1704067200037}]',)], "value string")).first()
    assert f.funding_rate == 0.0000125 and f.timestamp.microsecond == 37000 and f.premium is None
    meta = spark.createDataFrame([('{"universe":[{"name":"BTC","szDecimals":5,"maxLeverage":50},{"name":"kPEPE","szDecimals":0,"maxLeverage":10,"isDelisted":true}]}',)], "value string")
    assert rows(candles.parse_universe(meta).select("symbol", "asset_index", "is_delisted", "unit_multiplier"), "asset_index") == [("BTC", 0, False, 1), ("kPEPE", 1, True, 1000)]
    assert candles.parse_contexts(spark.createDataFrame([("1704067200000", "BTC", "42.5", "x")], "time string, coin string, oracle_px string, other string")).first().oracle_px == 42.5


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"dataset_id": "a", "source_venue": "Binance", "native_or_proxy": "proxy", "proxy_for": "Hyperliquid", "unit_multiplier": 1000, "hl_symbol": "kX", "binance_symbol": "1000XUSDT", "processing_version": "v1",
                                                 "retrieved_at": "2024-01-02T00:00:00+00:00", "checksum_manifest_entries": [{"month": "2024-01", "rows": 5}]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"dataset_id": "b", "source_venue": "Hyperliquid", "native_or_proxy": "proxy", "symbols": ["BTC"], "processing_version": "v2", "request_windows": [[1, 2]]}))
    c = catalog.read_sidecars(spark, str(tmp_path))
    a = c.where("dataset_id = 'a'").first()
    assert (a.own_unit_multiplier, a.venue_unit_multiplier) == (1000, 1000)
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset_id string")
    assert rows(catalog.catalog_status(d, c, "v2").select("dataset_id", "catalog_status"), "dataset_id") == [("a", "VERSION_MISMATCH"), ("b", "OK"), ("c", "MISSING")]
    assert rows(catalog.catalog_findings(c), "dataset_id", "code") == [("b", "OWN_VENUE_NOT_NATIVE"), ("b", "PROXY_FOR_REQUIRED")]
    p = {r.dataset_id: r for r in catalog.as_provenance(c).collect()}
    assert p["a"].symbol_mapping == "kX->1000XUSDT (1000, 1000)" and p["b"].symbol_mapping == "BTC" and p["a"].retrieval_date == dt.date(2024, 1, 2)


def test_records_and_history(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    stamp = {"$ts": "2024-01-01T00:00:00+00:00"}
    rec = {"experiment_id": "EXP-1", "schema_version": "s1", "exact_hash": "h", "run_seq": 0, "created_at": stamp, "status": "COMPLETED", "tags": ["a"], "backtest_config": {"fee_bps": 4.5, "funding_mode": "disabled"},
           "datasets": [{"dataset_id": "d", "data_start": stamp, "data_end": stamp, "eval_start": None, "symbols": ["BTC"]}], "results": {"metrics": {"sharpe": 1.5}, "n_periods": 3}, "code": {"contract_versions": {"data_processing_version": "v2"}}, "artifacts": []}
    text = json.dumps(rec, indent=1)
    (folder / "EXP-1.json").write_text(text)
    (folder / "EXP-2.json").write_text("{broken")
    r = records.read_records(spark, str(folder))
    one = r.where("experiment_id = 'EXP-1'").first()
    assert one.record_sha256 == hashlib.sha256(text.encode()).hexdigest() and one.metrics == {"sharpe": 1.5} and one.datasets[0].data_start == T0 and one.backtest_config["funding_mode"] == "disabled"
    assert records.unparseable_records(r).count() == 1
    lines, prev = [], None
    for seq, (event, payload) in enumerate([("created", {"record_sha256": one.record_sha256}), ("status_change", {"from": "COMPLETED", "to": "INVALID", "reason": "bug"}), ("annotation", {"note": "n", "tags_added": ["b", "a"]})], 1):
        lines.append(json.dumps({"seq": seq, "at": stamp, "event": event, "experiment_id": "EXP-1", "payload": payload, "prev_line_sha256": prev}))
        prev = hashlib.sha256(lines[-1].encode()).hexdigest()
    (tmp_path / "history.jsonl").write_text("\n".join(lines) + "\n")
    hist = records.read_history(spark, str(tmp_path / "history.jsonl"))
    assert experiments.chain_breaks(hist).count() == 0
    f = experiments.fold_status(r.where("experiment_id is not null"), hist).first()
    assert (f.folded_status, f.folded_reason, f.ever_invalid) == ("INVALID", "bug", True)
    assert experiments.registry_findings(r.where("experiment_id is not null"), records.created_events(hist), "s1").count() == 0
    assert rows(experiments.tags_and_notes(r.where("experiment_id is not null"), hist).select("kind", "text"), "kind", "text") == [("note", "n"), ("tag", "a"), ("tag", "b")]


def windows(*items):
    return json.dumps([dict(zip(("window_id", "status", "evaluation_start", "evaluation_end"), i)) for i in items])


def test_sealed_windows_fail_closed(spark, tmp_path):
    good = ("W", "SEALED", "2024-01-01T00:00:00+00:00", "2024-02-01T00:00:00Z")
    path = tmp_path / "w.json"
    path.write_text(windows(good, ("V", "OPEN", good[2], good[3])))
    assert [r.window_id for r in records.read_protected_windows(spark, str(path)).collect()] == ["W"]
    for bad in [windows(("W", "SEALED", "2024-01-01T00:00:00", good[3])), windows((None, "OPEN", good[2], good[3])), windows(("W", " ", good[2], good[3])), "[{", '{"window_id": 1}']:
        path.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            records.read_protected_windows(spark, str(path)).collect()


def test_bar_store(spark, tmp_path):
    b = spark.range(48).select(
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int") % 24)).alias("timestamp"), F.when(F.col("id") < 24, "A").otherwise("B").alias("symbol"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.lit(1).cast("bigint").alias("trade_count"), F.lit(True).alias("native_traded"))
    b = bars.stamp_attribution(b, "tape", "native", "hyperliquid_candle", "1h")
    path = str(tmp_path / "store")
    bar_store.write_bars(b, path, "tape", "1h", 2)
    got = bar_store.scan_bars(bar_store.read_bars(spark, path, "tape", "1h"), ["B"], "2024-01-01 02:00:00", "2024-01-01 05:00:00").select("timestamp", "close")
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(timestamp" in plan and "PartitionFilters: [isnotnull(venue" in plan
    assert "high:double" not in plan.split("ReadSchema")[1].split("\n")[0]
    with pytest.raises(Exception):  # noqa: B017  a store is not overwritten by accident
        bar_store.write_bars(b, path, "tape", "1h")
    f = spark.createDataFrame([(T0, "A", 0.1, None, None)], bar_store.FUNDING_SCHEMA)
    bar_store.write_funding(f, str(tmp_path / "funding"))
    assert bar_store.read_funding(spark, str(tmp_path / "funding")).count() == 1


def test_snapshots_are_written_once(spark, tmp_path):
    d = spark.createDataFrame([("A", T0 + dt.timedelta(days=i), float(i)) for i in range(10)], "symbol string, timestamp timestamp_ntz, x double")
    m = snapshots.seal(d, str(tmp_path), "set", T0 + dt.timedelta(days=2), T0 + dt.timedelta(days=5)).first()
    assert m.n_rows == 4  # both ends belong to it
    with pytest.raises(Exception):  # noqa: B017
        snapshots.seal(d, str(tmp_path), "set", T0, T0)
    assert snapshots.store_by_content(d, str(tmp_path)) == snapshots.store_by_content(d.orderBy(F.desc("x")), str(tmp_path))


def test_archives_in_a_folder(spark, tmp_path):
    """Files written by tasks, listed with a pattern, one damaged; sidecars beside them."""
    from pyspark.sql import functions as F

    from tapeledger.sources import kline
    from tapeledger.sources.files import write_files

    lines = spark.createDataFrame([(f"{s}USDT-1h-2024-0{m}.zip", i, f"{m},{i}") for s in ("A", "B") for m in (1, 2) for i in (1, 0)], "file string, line_no bigint, line string")
    zips = kline.zip_lines(lines)
    broken = zips.withColumn("content", F.when(F.col("file").startswith("BUSDT-1h-2024-02"), F.expr("substring(content, 1, 20)")).otherwise(F.col("content")))
    assert write_files(broken, str(tmp_path / "z")) == 4 and write_files(zips.limit(0), str(tmp_path / "z")) == 0
    name = F.element_at(F.split("file", "/"), -1)
    read = kline.read_archives(spark, str(tmp_path / "z"), kline.archive_pattern(["AUSDT", "BUSDT"], ["2024-02"]))
    assert sorted(r[0] for r in read.select(name).collect()) == ["AUSDT-1h-2024-02.zip", "BUSDT-1h-2024-02.zip"]
    assert [(r[0], r[1]) for r in kline.archive_findings(read).select(name, "code").collect()] == [("BUSDT-1h-2024-02.zip", "UNREADABLE_ARCHIVE")]
    assert [r.line for r in kline.archive_lines(read).orderBy("line_no").collect()] == ["2,0", "2,1"]
    assert {bytes(r.content) for r in kline.zip_lines(lines.repartition(5)).collect()} == {bytes(r.content) for r in zips.collect()}


def test_sidecar_findings(spark):
    from tapeledger.sources import catalog

    docs = spark.createDataFrame([("a", '{"dataset_id":"x"}'), ("b", '{"dataset_id":"x"}'), ("c", "{"), ("d", None), ("e", '{"dataset_id":" "}'), ("f", "[1]"), ("g", '{"dataset_id":"y"}')], "file string, value string")
    got = sorted((r.file, r.code) for r in catalog.sidecar_findings(docs).collect())
    assert got == [("b", "DUPLICATE_DATASET"), ("c", "UNPARSEABLE_SIDECAR"), ("d", "UNPARSEABLE_SIDECAR"), ("e", "MISSING_DATASET_ID"), ("f", "UNPARSEABLE_SIDECAR")]
