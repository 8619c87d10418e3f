"""The commands, end to end on small files."""

import json

import pytest
from code_facts import FACTS

from veriframe import cli


@pytest.fixture
def files(tmp_path):
    kb = tmp_path / "kb"
    kb.mkdir()
    (kb / "a.md").write_text("# Linking\nNode L.1.1 is about linking data of one person.\n## Other\nSomething else.\n")
    put = lambda name, x: ((tmp_path / name).write_text(json.dumps(x)), str(tmp_path / name))[1]
    f = {"kb": str(kb), "dir": tmp_path}
    f["dfd"] = put("d.json", {"elements": [{"id": "EE1", "type": "ExternalEntity", "name": "U"}, {"id": "P1", "type": "Process", "name": "P"}], "flows": [{"id": "DF1", "source": "EE1", "destination": "P1", "description": "asks"}]})
    f["gold"] = put("gold.json", {"threats": [{"id": 1, "interaction": "x [DF1]", "threat_type": "L", "tree_node": "L.1.1", "panoptic_actions": ["PA01.01"]}]})
    f["gen"] = put("gen.json", [{"flow_id": "DF1", "originator_id": "EE1", "threat_type": t, "tree_node": "L.1.1", "position": "S", "panoptic_action": "PA01.01"} for t in ("L", "U")])
    f["trees"] = put("trees.json", {"threat_types": {"L": {"name": "Linking", "nodes": {"L.1.1": {"title": "t", "description": "d"}}}}})
    f["facts"] = put("facts.json", {"facts": [dict(zip(("id", "construct", "file", "line", "end_line", "fields", "derived", "confidence"), x)) for x in FACTS]})
    f["keys"] = put("keys.json", {"elements": {"P1": {"kind": "route_mount", "key": "/api/videos"}, "DS1": {"kind": "fs_path", "key": "uploads"}}})
    return f


def test_commands(spark, files, capsys):
    d = str(files["dir"])
    corpus = ["--corpus", f"linddun={files['kb']}", "--store", f"{d}/index"]
    cli.main(["build", *corpus])
    cli.main(["stats", *corpus])
    cli.main(["search", "L.1.1 linking", "-k", "1", *corpus])
    cli.main(["ask", "L.1.1 linking", "-k", "1", "--source", "linddun", *corpus])
    out = capsys.readouterr().out
    assert "linddun:a.md:0" in out and "Node L.1.1 is about" in out
    scenario = ["--generated", files["gen"], "--gold", files["gold"], "--dfd", files["dfd"]]
    cli.main(["eval", *scenario, "--trees", files["trees"], "--by-node"])
    assert "ALL            1     1     0" in capsys.readouterr().out
    cli.main(["eval", *scenario, "--trees", files["trees"], "--framework", "panoptic"])
    for _ in range(2):
        cli.main(["adjudicate", *scenario, "--worklist", f"{d}/work"])
    cli.main(["adjudicate", *scenario, "--worklist", f"{d}/work", "--report-only"])
    assert spark.read.json(f"{d}/work").count() == 1
    capsys.readouterr()
    cli.main(["derive", "--facts", files["facts"], "--out", f"{d}/x"])
    assert "/api/videos" in capsys.readouterr().out
    cli.main(["enrich", "--facts", files["facts"], "--out", f"{d}/x"])
    cli.main(["verify-dfd", "--facts", files["facts"], "--out", f"{d}/x"])
    cli.main(["eval-dfd", "--facts", files["facts"], "--out", f"{d}/x", "--against", files["dfd"], "--keys", files["keys"]])
    assert "derivable_recall" in capsys.readouterr().out
    assert cli.check(files["dfd"], spark) == []


def test_image_command(spark, files, capsys):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(60, 40, 5)
    for y in range(40):
        for x in range(60):
            image.setRGB(x, y, 0 if 10 <= x < 30 and 10 <= y < 20 else 0xFFFFFF)
    path = str(files["dir"] / "i.png")
    jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(path))
    boxes = files["dir"] / "b.json"
    boxes.write_text(json.dumps({"elements": [{"id": "P1", "type": "Process", "name": "a", "provenance": [{"bbox": [10, 10, 20, 10]}]}, {"id": "P2", "type": "Process", "name": "b", "provenance": [{"bbox": [40, 25, 5, 5]}]}], "flows": []}))
    cli.main(["verify-image", "--dfd", str(boxes), "--image", path])
    rows = {x.split("|")[2].strip(): x for x in capsys.readouterr().out.splitlines() if x.count("|") > 4}
    assert "true" in rows["P1"].split("|")[4] and "false" in rows["P2"].split("|")[4]
