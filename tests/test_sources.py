"""Labelled folders with sidecars, and digests of tables whose volatile names lie at any depth."""

import json

import pytest

from casemill.sources import stores

SCHEMA = "tier int, gaps array<string>"
NESTED = "id int, at string, body struct<event_id:string,name:string,parts:array<struct<event_id:string,n:int>>>, more map<string,struct<event_id:string,v:int>>"


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_labelled_files_need_a_sidecar_each(spark, tmp_path):
    whole = put(tmp_path / "a", one__txt="größe\ntwo lines", one__labels__json=json.dumps({"tier": 2, "gaps": ["x"]}), two__txt=" ", two__labels__json="{}")
    got = {r["item_id"]: (r["text"], r["tier"], r["gaps"]) for r in stores.labelled_files(spark, whole, SCHEMA).collect()}
    assert got == {"one": ("größe\ntwo lines", 2, ["x"]), "two": (" ", None, None)}
    for name, files, error in (("b", {"one__txt": "x"}, "no label for 'one'"), ("c", {"one__labels__json": "{}"}, "no item for 'one'"), ("d", {"one__txt": "x", "one__labels__json": "[1"}, "broken label of 'one'"), ("e", {"readme__md": "x"}, "empty corpus")):
        with pytest.raises(ValueError, match=error):
            stores.labelled_files(spark, put(tmp_path / name, **files), SCHEMA)


def test_digest_sees_every_leaf_but_the_volatile_ones(spark):
    def table(event="e1", n=5, v=7, at="now", extra=()):
        return spark.createDataFrame([(1, at, (event, "x", [(event, n), (None, None)]), {"k": (event, v), "j": None}), (2, at, None, None), *extra], NESTED)

    one = stores.digest(table(), "event_id", "at")
    assert one == stores.digest(table("e2", at="later").repartition(5).select("more", "body", "id", "at"), "event_id", "at")
    others = [table(n=6), table(v=8), table(extra=[(2, "now", None, None)]), spark.createDataFrame(table().collect()[:1], NESTED), table().limit(0)]
    assert len({one, *(stores.digest(t, "event_id", "at") for t in others)}) == 6
    assert one != stores.digest(table()) and stores.digest(table()) != stores.digest(table("e2"))
