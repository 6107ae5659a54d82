"""Files, line numbers, encoding, streams, reports and the command line."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logshape import cli
from logshape.operators import dictionary
from logshape.plans.config import Config
from logshape.plans.extract import analyse
from logshape.plans.report import json_report, text_report
from logshape.plans.scratch import scratch_dir
from logshape.sources.binary_file import read_binary, write_binary
from logshape.sources.lines import read_lines
from logshape.streaming.templates import read_stream, template_counts

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def numbered(df):
    return sorted((r.file_id, r.line_no, r.line) for r in df.collect())


def test_line_numbers_over_splits(spark, tmp_path):
    lines = {0: [f"a line {i} {'x' * (i % 50)}" for i in range(4000)], 1: [""], 2: [], 3: ["no end"]}
    for i, own in lines.items():
        (tmp_path / f"f{i}.log").write_text("\n".join(own) + ("\n" if own and i != 3 else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = numbered(read_lines(spark, [str(tmp_path / f"f{i}.log") for i in lines]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, j, x) for i, own in lines.items() for j, x in enumerate(own)]


def test_line_ends(spark, tmp_path):
    f = tmp_path / "x.log"
    f.write_bytes(b"a b\r\nc\rd\n\n e")
    assert [x[2] for x in numbered(read_lines(spark, [str(f)], universal=True))] == ["a b", "c", "d", "", " e"]
    assert [x[2] for x in numbered(read_lines(spark, [str(f)]))] == ["a b\r", "c\rd", "", " e"]
    with pytest.raises(FileNotFoundError):
        read_lines(spark, [str(tmp_path / "none")])


TEXT = "  two  words \n\n\tthree more words\r\nx\n" + "w" * 60_000 + "\n" + "v " * 1000 + "\n日本 é\n"
NORMAL = ["two words", "three more words", "x", "w" * 60_000, " ".join(["v"] * 1000), "日本 é"]


def test_encode_and_decode(spark, tmp_path, capsys):
    (tmp_path / "in.log").write_text(TEXT)
    assert cli.main(["encode", str(tmp_path / "in.log"), str(tmp_path / "enc")], spark) == 0
    assert "Tokens: 9" in capsys.readouterr().out
    assert cli.main(["decode", str(tmp_path / "enc"), str(tmp_path / "out")], spark) == 0
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).splitlines() == NORMAL
    assert cli.main(["decode", str(tmp_path / "nothing"), str(tmp_path / "o2")], spark) == 1


def test_binary_form(spark, tmp_path):
    (tmp_path / "in.log").write_text(TEXT)
    lines = read_lines(spark, [str(tmp_path / "in.log")], universal=True)
    words, coded = dictionary.encode(lines)
    assert [r.token for r in words.orderBy("token_id").limit(5).collect()] == ["two", "words", "three", "more", "x"]
    target = str(tmp_path / "log.bin")
    size = write_binary(words, coded, len(TEXT), target)
    assert size == os.path.getsize(target) == dictionary.sizes(lines).first().encoded_size
    back = dictionary.decode(*read_binary(spark, target))
    assert [r.line for r in back.orderBy("line_no").collect()] == NORMAL
    raw = open(target, "rb").read()
    for bad in (raw[:20], b"XXXX" + raw[4:], raw[:-3]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            read_binary(spark, str(tmp_path / "bad"))
    unknown = dictionary.decode(words, spark.createDataFrame([(0, 0, [0, 999])], "file_id int, line_no long, ids array<long>"))
    assert unknown.first().line == "two "


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \tab1é=;", max_size=12), max_size=8))
def test_round_trip_is_normalisation(spark, lines):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "file_id int, line_no long, line string")
    got = [r.line for r in dictionary.round_trip(df).orderBy("line_no").collect()]
    assert got == [" ".join(x.split()) for x in lines if x.split()]


def test_reports(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("start job 1\nstart job 2\nonly here /tmp/x\n")
    b.write_text("start job 3\nother 10.0.0.1\n")
    one = Config([str(a)], variables=True, analyze=True, top_n=1)
    text = text_report(analyse(spark, one), one)
    assert "start job <NUM>" in text and "(+1 more)" in text and "Similar templates" in text and "<NUM>" in text
    quiet = Config([str(a)], quiet=True)
    assert "start job" not in text_report(analyse(spark, quiet), quiet)
    two = Config([str(a), str(b)])
    result = analyse(spark, two)
    text = text_report(result, two)
    assert "templates in all files: 1" in text and "only here <PATH>" in text and "other <IP>" in text
    out = json.loads(json_report(result, two))
    assert out["common_templates"]["shown"] == ["start job <NUM>"] and out["unique_templates"][str(b)]["shown"] == ["other <IP>"]


def test_commands(spark, tmp_path, capsys):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("x 1\nskip\n")
    b.write_text("x 2\n")
    assert cli.main([str(a)], spark) == 0 and "x <NUM>" in capsys.readouterr().out
    assert cli.main([str(a), str(b), "-x", "skip", "--status"], spark) == 0
    assert cli.main([str(a), str(b), "--status"], spark) == 1
    assert cli.main([str(tmp_path / "none")], spark) == 1 and cli.main(["--nonsense"], spark) == 1 and cli.main(["-h"], spark) == 1
    capsys.readouterr()
    assert cli.main(["bench", "tokens", str(a)], spark) == 0 and "Tokens: 3" in capsys.readouterr().out
    for text, n in (("a\n\nb", 2), ("a\r\nb\rc\n", 3), ("", 0), ("a", 0)):  # line ends are counted
        b.write_bytes(text.encode())
        assert cli.main(["bench", "tokens", str(b)], spark) == 0 and f"Lines: {n}\n" in capsys.readouterr().out
    assert cli.main(["encode", str(a), "/proc/none/enc"], spark) == 1 and "logshape:" in capsys.readouterr().err
    (tmp_path / "enc" / "dictionary").mkdir(parents=True)
    (tmp_path / "enc" / "lines").mkdir()
    (tmp_path / "enc" / "dictionary" / "x.parquet").write_bytes(b"no table")
    (tmp_path / "enc" / "lines" / "x.parquet").write_bytes(b"no table")
    assert cli.main(["decode", str(tmp_path / "enc"), str(tmp_path / "o")], spark) == 1
    assert cli.main(["bench", "templates", str(a)], spark) == 0


def test_groups(spark, tmp_path, capsys):
    for name, text in (("a", "both w\nleft x\n"), ("b", "both w\nleft x\n"), ("c", "both w\nright y\n")):
        (tmp_path / name).write_text(text)
    files = [str(tmp_path / x) for x in "abc"]
    assert cli.main([*files, "--groups", "0,1:2"], spark) == 0
    out = capsys.readouterr().out
    assert "templates only in group A: 1" in out and "templates only in group B: 1" in out and "templates in both groups: 1" in out
    assert cli.main([*files, "--groups", "0,1:2", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["groups_templates"]["a_only"] == {"total": 1, "shown": ["left x"]}
    assert cli.main([*files, "--groups", "0:0"], spark) == 1 and cli.main([*files, "--groups", "x"], spark) == 1 and cli.main([*files, "--groups", "0:7"], spark) == 1


def test_hot_tokens(spark, monkeypatch):
    """Tokens that are joined from a broadcast, and those that are not, come back alike."""
    lines = spark.createDataFrame([(0, i, f"the w{i} the") for i in range(50)] + [(0, 60, None), (0, 61, "")], "file_id int, line_no long, line string")
    for hot in (1, 3, 20_000):
        monkeypatch.setattr(dictionary, "HOT", hot)
        assert sorted(r.line for r in dictionary.round_trip(lines).collect()) == sorted(f"the w{i} the" for i in range(50))
    words, coded = dictionary.encode(lines)
    size = dictionary.sizes(lines).first()
    assert dictionary.sizes_of(words, coded, size.original_size).first() == size


def test_shared_folder(spark):
    class Other:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError):
        scratch_dir(Other())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.log").write_text("job 1 done\njob 2 done\n\nother\n")
    out = template_counts(read_stream(spark, str(tmp_path / "in")), "arrived", "1 day")
    q = out.writeStream.format("memory").queryName("templates_seen").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.cnt for r in spark.table("templates_seen").collect()) == [1, 2]


def test_entry_without_the_training_data_package(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and not set(s) - set(q) and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
