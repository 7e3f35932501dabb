"""The verbs on small folders."""

import json

import pytest

from sceneloom import __main__ as verbs
from sceneloom.sources import scenes


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "scripts").mkdir()
    for name, text in (("one", "Hi\n*label a\n*set x (1 + 2)"), ("two", "*goto_scene one 5"), ("gone", scenes.MISSING_SCENE)):
        (tmp_path / "scripts" / f"{name}.txt").write_text(text)
    verbs.main(["scan", str(tmp_path / "scripts"), str(tmp_path / "tokens")])
    read = json.loads("".join(p.read_text() for p in sorted((tmp_path / "tokens").glob("part-*"))))
    assert [[t["type"] for t in scene][:3] for scene in read] == [["SceneStart", "Prose", "Label"], ["SceneStart", "GotoScene", "Identifier"]]
    verbs.main(["parse", str(tmp_path / "tokens"), str(tmp_path / "parsed")])
    assert {r.scene_name: (r.parsed, r.n_statements) for r in spark.read.parquet(str(tmp_path / "parsed/outcome")).collect()} == {"one": (True, 3), "two": (False, 0)}
    assert spark.read.parquet(str(tmp_path / "parsed/statements")).count() == 4
    verbs.main(["parse", str(tmp_path / "tokens"), str(tmp_path / "parsed"), "--semantics", "observed"])
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "parsed/statements")).filter("scene_name = 'two'").orderBy("place").collect()] == ["GotoScene", "Error"]


def test_types(spark, tmp_path):
    at = tmp_path / "tokens"
    (at / "more").mkdir(parents=True)
    (at / "index.ts").write_text("export * from './if';\nexport * from './more';\nexport * from './token';\n")
    (at / "if.ts").write_text("export interface IfToken extends Token {\n  value: { type: 'inner' };\n  type: 'If';\n}\nexport * from './unseen';")
    (at / "unseen.ts").write_text("interface UnseenToken extends Token { type: 'Unseen' }")
    (at / "token.ts").write_text("interface Token { type: string }")
    (at / "more/index.ts").write_text("export * from '../index'; export * from './else'")
    (at / "more/else.ts").write_text("interface ElseToken extends Token { type: \"Else\" }\ninterface NoToken extends Token { x: 1 }")
    verbs.main(["types", str(at), str(tmp_path / "out"), "--index", "tokens/index.ts"])
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "'Else' | 'If'"
    with pytest.raises(SystemExit, match="no file"):
        verbs.main(["types", str(at), str(tmp_path / "out"), "--index", "nothing.ts"])
    with pytest.raises(SystemExit, match="more than one"):
        verbs.main(["types", str(at), str(tmp_path / "out")])
