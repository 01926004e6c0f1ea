"""Sinks and the command line."""

import glob
import json

import pytest

from ranksight import cli
from ranksight.operators.lifecycle import current
from ranksight.sources import sinks


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.123456, None), (2, None, "x")], "id int, score double, t string")
    assert [json.loads(r.value) for r in sinks.json_rows(rows).collect()] == [{"id": 1, "score": 0.1235}, {"id": 2, "t": "x"}]
    sinks.write_json(rows, str(tmp_path / "j"))
    assert len(glob.glob(str(tmp_path / "j" / "part-*"))) >= 1
    tasks = spark.createDataFrame([("2", "B;x", "2026-01-31"), ("1", "A", "2026-02-30"), ("3", None, None), ("4", "C", "2026-01-01")], "id string, title string, deadline string")
    sinks.write_calendar(tasks, str(tmp_path / "c"), "20260101T000000Z")
    (name,) = glob.glob(str(tmp_path / "c" / "part-*"))
    text = open(name, newline="").read()
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VCALENDAR\r\n") and text.count("BEGIN:VEVENT") == 2
    assert "DTSTART;VALUE=DATE:20260131\r\nDTEND;VALUE=DATE:20260201\r\nSUMMARY:B\\;x\r\n" in text
    files = spark.createDataFrame([("a/b.md", "x\r\ny"), ("../out.md", "no"), (None, "no"), ("n.md", None)], "path string, content string")
    assert sinks.write_texts(files, str(tmp_path / "w")) == 1 and (tmp_path / "w/a/b.md").read_bytes() == b"x\r\ny"
    assert not (tmp_path / "out.md").exists() and sinks.write_texts(files.limit(0), str(tmp_path / "w")) == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "kb" / "a").mkdir(parents=True)
    (tmp_path / "kb" / "a" / "SKILL.md").write_text("---\nname: A\n---\n# Apples\nred apples")
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    run = lambda *a: cli.main([a[0], a[1], str(tmp_path / "kb"), *a[2:], "--index", str(tmp_path / "ix")])
    run("kb", "index")
    assert json.loads(capsys.readouterr().out)["new"] == 1
    run("kb", "search", "apple")
    assert json.loads(capsys.readouterr().out.splitlines()[0])["path"] == "a/SKILL.md"
    run("kb", "status")
    assert json.loads(capsys.readouterr().out)["same"] == 1
    run("kb", "reindex")
    assert current(spark, str(tmp_path / "ix"))
    (tmp_path / "kb" / "tasks").mkdir()
    (tmp_path / "kb" / "tasks" / "3-x.md").write_text("---\nid: 3\ntitle: T\nstatus: open\n---\nb")
    run("tasks", "close", "3", "--write", "--today", "2026-03-01", "--remark", "bye")
    assert (tmp_path / "kb/tasks/archive/3-x.md").read_text().endswith("b\n\nbye\n") and not (tmp_path / "kb/tasks/3-x.md").exists()
    capsys.readouterr()
    run("tasks", "next-id")
    assert json.loads(capsys.readouterr().out)["next_id"] == 4
    run("maintain", "lint")
    assert {json.loads(x)["rule"] for x in capsys.readouterr().out.splitlines()} >= {"no_category", "index_drift"}
    run("graph", "find", "a")
    assert json.loads(capsys.readouterr().out)["name"] == "A"
    with pytest.raises(SystemExit):
        run("graph", "search")
    with pytest.raises(SystemExit):
        run("kb", "search")
    with pytest.raises(FileNotFoundError):
        monkeypatch.delenv("PROJECT_ROOT", raising=False)
        cli.find_root("/proc")
    (tmp_path / ".agents").mkdir()
    assert cli.find_root(str(tmp_path / "kb" / "a")) == str(tmp_path)
