"""The command line's commands, end to end on small inputs."""

import json

from weftnet import cli


def test_gen_and_solve(spark, tmp_path, capsys):
    assert cli.main(["gen", str(tmp_path / "i"), "--width", "4", "--height", "4", "--steps", "5", "--commodities", "4"]) == 0
    assert cli.main(["solve", str(tmp_path / "i"), "--result", str(tmp_path / "r"), "--flow", str(tmp_path / "f")]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert got["lb"] <= got["ub"] + 1e-9
    assert spark.read.text(str(tmp_path / "f")).first()[0].startswith("f ")


def test_design(spark, tmp_path, capsys):
    edges = [(0, 1, 100), (1, 2, 100), (3, 0, 10), (4, 2, 10)]
    lines = ["g 5 8", *(f"v {i} {-122.4 + i / 1000} 37.77" for i in range(5)), *(f"e {a} {b} {w}\ne {b} {a} {w}" for a, b, w in edges)]
    (tmp_path / "g").write_text("\n".join(lines) + "\n")
    (tmp_path / "p").write_text("3\n4\n")
    assert cli.main(["design", "--graph", str(tmp_path / "g"), "--points", str(tmp_path / "p"), "--engine", "driver", "--solution", str(tmp_path / "s"), "--result", str(tmp_path / "r")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["total_cost"] == 22200
    assert {r[0][0] for r in spark.read.text(str(tmp_path / "s")).collect()} == {"h", "e", "p"}
