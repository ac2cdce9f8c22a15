"""Chat databases and saved vector stores, several in one read, some of them damaged."""

from __future__ import annotations

import json
import sqlite3

from tidemark.operators import chunking
from tidemark.sources import chats, files, stores


def database(path, rows):
    base = sqlite3.connect(path)
    base.execute(f"CREATE TABLE {stores.TABLE} (key TEXT PRIMARY KEY, value BLOB)")
    base.executemany(f"INSERT INTO {stores.TABLE} VALUES (?, ?)", rows)
    base.commit()
    base.close()


def test_several_databases_of_which_one_is_damaged(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    head = json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "x", "type": 1}]})
    one = [(f"{chats.HEAD}c1", head.encode()), (f"{chats.BUBBLE}c1:x", json.dumps({"type": 1, "text": "hé"})), ("else:1", b"no"), (f"{chats.HEAD}c9", None)]
    database(tmp_path / "one.vscdb", one)
    database(tmp_path / "deep" / "two.vscdb", [(f"{chats.HEAD}c2", head.replace('"x"', '"y"')), (f"{chats.BUBBLE}c2:y", json.dumps({"type": 2, "text": "two"}))] + [(f"{chats.BUBBLE}zz:{i}", "{}" * 500) for i in range(3000)])
    whole = (tmp_path / "deep" / "two.vscdb").read_bytes()
    (tmp_path / "cut.vscdb").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "noise.vscdb").write_bytes(b"not a database")
    (tmp_path / "empty.vscdb").write_bytes(b"")
    sqlite3.connect(tmp_path / "bare.vscdb").execute("CREATE TABLE other (a)").connection.close()
    kv = stores.read_chat_stores(spark, str(tmp_path))
    assert {r.store.rsplit("/", 1)[-1] for r in kv.select("store").distinct().collect()} == {"one.vscdb", "two.vscdb"}
    assert kv.where("key like 'else%'").count() == 0 and kv.count() == 3005
    assert sorted((r.conv_id, r.role, r.text) for r in chats.messages(kv).collect()) == [("c1", "user", "hé"), ("c2", "assistant", "two")]
    bad = stores.damaged(stores.files_at(spark, str(tmp_path), "*.vscdb")).collect()
    assert sorted(r.store.rsplit("/", 1)[-1] for r in bad) == ["bare.vscdb", "cut.vscdb", "noise.vscdb"] and all(r.problem for r in bad)
    assert [r.key for r in stores.key_values(stores.files_at(spark, str(tmp_path), "one*"), ("else:",)).collect()] == ["else:1"]


def test_saved_stores(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"d1": {"content": "ü", "embedding": [1, 2.5], "metadata": {"source": "s", "n": [1]}}, "d2": {"content": None}}))
    (tmp_path / "b.json").write_text('{"d3": {"content": "x"}')
    (tmp_path / "c.json").write_text("[1]")
    (tmp_path / "d.json").write_text("{}")
    got = {r.id: (r.content, r.embedding, r.metadata and json.loads(r.metadata)) for r in stores.saved_documents(stores.files_at(spark, str(tmp_path))).collect()}
    assert got == {"d1": ("ü", [1.0, 2.5], {"source": "s", "n": [1]}), "d2": (None, None, None)}


def test_batches_of_text_ids(spark):
    ids = [f"id{i * 7919 % 100:03d}" for i in range(100)]
    df = spark.createDataFrame([(i,) for i in ids], "chunk_id string").repartition(5)
    got = {r.chunk_id: r.group for r in chunking.uniform_groups(df, 10).collect()}
    assert got == {i: f"batch_{n // 10}" for n, i in enumerate(sorted(ids))}
    assert chunking.uniform_groups(df.limit(0), 10).count() == 0


def test_skills_of_several_folders(spark, tmp_path):
    for folder, name, text in (("home/x", "a", "global a"), (".agent/skills", "a", "universal a"), ("here", "b", "project b")):
        at = tmp_path / folder / name
        at.mkdir(parents=True)
        (at / "SKILL.md").write_text(f"---\nname: {name}\ndescription: {text}\n---\nbody")
    paths = ["~/x", str(tmp_path / ".agent/skills"), str(tmp_path / "absent"), str(tmp_path / "here")]
    skills = files.discover_skills(spark, paths, str(tmp_path / "home"))
    assert sorted((r.name, r.location, r.place) for r in skills.collect()) == [("a", "global", 0), ("a", "universal", 1), ("b", "project", 3)]
    assert [r.description for r in files.skill_named(skills, "a").collect()] == ["universal a"]
    assert files.discover_skills(spark, [str(tmp_path / "absent")]).count() == 0
