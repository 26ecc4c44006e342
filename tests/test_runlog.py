import datetime as dt
import json

import pytest

from tablesync import RunLog
from tablesync import runlog as R

T0 = dt.datetime(2013, 10, 8, 13, 58, 51)


def later(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def runs(spark):
    rows = [
        ("a", "finished", T0, later(10)),
        ("b", "failed", later(1), later(700)),
        ("c", "queued", later(2), None),
        ("d", "in_process", later(2), None),
        ("e", "finished", later(3), None),
    ]
    return spark.createDataFrame(rows, "id string, status string, time_added timestamp_ntz, time_finished timestamp_ntz")


def test_listing_is_newest_first(runs):
    assert [r["id"] for r in R.list_runs(runs).collect()] == ["e", "c", "d", "b", "a"]


def test_counts_include_zeros(runs):
    assert R.status_counts(runs.filter("id = 'c'")).first().asDict() == {
        "num_queued_jobs": 1, "num_in_process_jobs": 0, "num_finished_jobs": 0, "num_failed_jobs": 0,
    }


@pytest.mark.parametrize("now, kept", [(610, "abcde"), (611, "bcde"), (1300, "bcde"), (1301, "cde"), (99999, "cde")])
def test_retention(runs, now, kept):
    assert "".join(sorted(r["id"] for r in R.unexpired(runs, later(now)).collect())) == kept


def test_json_of_a_pull_and_a_removal(spark, folder):
    log = RunLog(spark, folder, max_age_seconds=10**10)
    common = dict(layer_name="africa", time_added=T0)
    log.append(id="p", type=R.PULL, status=R.QUEUED, filter='id="4"', **common)
    assert log.get("p") == {
        "id": "p", "timeAdded": "2013-10-08T13:58:51Z", "type": "pull", "status": "queued",
        "layerName": "africa", "filter": 'id="4"', "message": "",
    }
    log.append(
        id="p", type=R.PULL, status=R.FINISHED, filter='id="4"', time_finished=later(1),
        num_pulled=2, num_updated=2, **common,
    )
    done = log.get("p")
    assert done["timeFinished"] == "2013-10-08T13:58:52Z"
    assert {k: v for k, v in done.items() if k.startswith("num")} == {
        "numPulled": 2, "numCreated": 0, "numUpdated": 2, "numDeleted": 0, "numIgnored": 0,
    }
    sets = [{"column1": "some value", "column2": None}]
    log.append(id="r", type=R.REMOVE, status=R.QUEUED, attribute_sets=json.dumps(sets), **common)
    assert log.get("r")["attributeSets"] == sets and "filter" not in log.get("r")


def test_the_newest_record_counts(spark, folder):
    log = RunLog(spark, folder)
    for status, at in ((R.FINISHED, 5), (R.QUEUED, 0), (R.IN_PROCESS, 1)):
        log.append(id="x", status=status, time_added=T0, time_finished=R.utc_now(), recorded=later(at))
    assert log.runs().count() == 1
    assert log.status()["num_finished_jobs"] == 1


def test_expiry_drops_days_without_listed_runs(spark, folder):
    log = RunLog(spark, folder)
    for day in (1, 2):
        at = T0.replace(day=day)
        log.append(id=f"done{day}", status=R.FINISHED, time_added=at, time_finished=at)
    log.append(id="open", status=R.IN_PROCESS, time_added=T0.replace(day=2))
    log.expire()
    assert [d for d in log._days()] == ["20131002"]
    log.append(id="open", status=R.FINISHED, time_added=T0.replace(day=2), time_finished=T0)
    log.expire()
    assert log._days() == [] and log.list().count() == 0


def test_expiry_keeps_open_and_new_runs(spark, folder):
    log = RunLog(spark, folder)
    log.append(id="old", status=R.FINISHED, time_added=T0, time_finished=later(1))
    log.append(id="new", status=R.FINISHED, time_added=R.utc_now(), time_finished=R.utc_now())
    log.append(id="waiting", status=R.QUEUED, time_added=T0)
    log.expire()
    assert sorted(r["id"] for r in log.list().collect()) == ["new", "waiting"]
    log.append(id="next", status=R.QUEUED, time_added=R.utc_now())
    assert log.runs().count() == 3


def test_empty_log(spark, folder):
    log = RunLog(spark, folder)
    assert log.list().count() == 0 and log.status()["num_failed_jobs"] == 0
    with pytest.raises(KeyError):
        log.get("x")
    with pytest.raises(ValueError):
        log.append(id="x", colour="red")


def test_times_do_not_depend_on_the_session_time_zone(spark, folder):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        log = RunLog(spark, folder, max_age_seconds=60)
        log.append(id="x", status=R.FINISHED, time_added=T0, time_finished=R.utc_now())
        assert log.get("x")["timeAdded"] == "2013-10-08T13:58:51Z"
        assert log.list().first()["time_added"] == T0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_run_ids():
    ids = {R.new_run_id() for _ in range(100)}
    assert len(ids) == 100 and all("-" not in i for i in ids)
