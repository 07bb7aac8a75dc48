"""Log records of several lines, across file splits."""

import random
import re

import pytest

from milepost.sources import logs


def write_logs(folder, seed=1):
    rng = random.Random(seed)
    want = []
    for f in range(3):
        records = [("no_header", "no record yet\n  - and more", 2)] if f == 1 else []
        for i in range(60):
            bad = rng.random() < 0.1
            time = "2024-13-41 10:00:00" if bad else f"2024-01-{rng.randint(1, 28):02d} 10:00:{i % 60:02d}"
            more = rng.choice([0, 0, 0, 3, 40])  # 40 lines are longer than several splits
            level = rng.choice(["INFO", "CRITICAL"])
            message = f"event {i} - part" + "".join(rng.choice([f"\n  line {k} é", "", "\n"]) for k in range(more))
            text = f"{time} - tool-{f} - {level} - {message}"
            records.append(("bad_time" if bad else "record", text, text.count("\n") + 1))
        (folder / f"f{f}.log").write_text("\n".join(r[1] for r in records) + "\n")
        want += records
    (folder / "empty.log").write_text("")
    (folder / "only.log").write_text("just\ntext")
    return want + [("no_header", "just\ntext", 2)]


@pytest.mark.parametrize("split", ["100m", "300", "97"])
def test_records_across_splits(spark, tmp_path, split):
    want = write_logs(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = logs.scan_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (len({(r.file, r.offset) for r in rows}) > 50) == (split != "100m")
    whole = {}
    for status, text, n in want:
        message = re.sub(r"^\S+ \S+ - \S+ - [A-Z]+ - ", "", text) if status == "record" else text
        key = (status, message, n)
        whole[key] = whole.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.status, r.message, r.lines)
        got[key] = got.get(key, 0) + 1
        assert (r.ts is None) == (r.logger is None) == (r.level is None) == (r.status != "record")
    assert got == whole


def test_level_counts_show_rejects(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "lost\n2024-01-01 00:00:01 - t - INFO - one\n2024-01-01 00:00:02 - t - CRITICAL - two\nTraceback:\n  x - y - Z - w\n"
        "2024-99-01 00:00:02 - t - INFO - three\n"
    )
    out = logs.level_counts(logs.scan_records(spark, str(tmp_path)))
    got = {(str(r.day), r.level, r.status, r.records, r.lines) for r in out.collect()}
    assert got == {
        ("2024-01-01", "INFO", "record", 1, 1),
        ("2024-01-01", "CRITICAL", "record", 1, 3),
        ("None", None, "no_header", 1, 1),
        ("None", None, "bad_time", 1, 1),
    }
