import random
from pathlib import Path

import pytest

from paperloom.operators.incremental import create_kept, insert_kept, kept_rows
from paperloom.operators.tables import BucketFolders

KIND = "scope string, ord long, doi_key string, title_key string"


def walk(rows):
    taken, kept = set(), set()
    for scope, at, doi, title in sorted(rows, key=lambda row: (row[0], row[1])):
        keys = {(scope, side, key) for side, key in (("doi", doi), ("title", title)) if key is not None}
        if keys and not keys & taken:
            kept.add((scope, at))
            taken |= keys
    return kept


@pytest.mark.parametrize(("seed", "keys"), [(2, 60)])
def test_insertions_give_the_walk_over_all(spark, tmp_path, seed, keys):
    rng = random.Random(seed)
    path = str(tmp_path / "kept")

    def some(ords):
        pick = lambda side: None if rng.random() < 0.15 else f"{side}{0 if rng.random() < 0.2 else rng.randrange(keys)}"
        return [(rng.choice("ab"), at, pick("d"), pick("t")) for at in ords]

    ords = rng.sample(range(10_000), 300)
    rows = some(ords[:200])
    create_kept(spark.createDataFrame(rows, KIND), path, bucket_entries=60)
    for start, end in ((200, 230), (230, 300)):
        new = some(ords[start:end])
        before = walk(rows)
        rows += new
        found = insert_kept(spark, path, spark.createDataFrame(new, KIND)).collect()
        want = walk(rows)
        assert {tuple(row) for row in kept_rows(spark, path).collect()} == want
        looked_at = {(row.scope, row.ord): row.kept for row in found}
        assert all(((scope, at) in want) == kept for (scope, at), kept in looked_at.items())
        assert before ^ want <= set(looked_at)


def test_reads_the_buckets_of_reached_keys_only(spark, tmp_path):
    """Everything else is made unreadable."""
    path = str(tmp_path / "kept")
    rows = [("s", n, f"d{n // 2}", f"t{n}") for n in range(0, 4_000, 2)]
    create_kept(spark.createDataFrame(rows, KIND), path, bucket_entries=100)
    new = spark.createDataFrame([("s", 1_001, "d500", "t1002")], KIND)
    table = BucketFolders(spark, path)
    asked = spark.createDataFrame([("s", side, key) for side, key in (("doi", "d500"), ("title", "t1000"), ("title", "t1002"), ("doi", "d501"))], "scope string, side string, key string")
    used = {f"bucket={row[0]}" for row in asked.select(table.bucket()).collect()}
    folders = [folder for folder in Path(path, "rows").iterdir() if folder.name.startswith("bucket=")]
    assert len(folders) > 35
    for folder in folders:
        if folder.name not in used:
            for file in [*folder.glob("*.parquet")]:
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
                file.write_bytes(b"not a table")
    found = insert_kept(spark, path, new).collect()
    assert [(row.ord, row.was, row.kept) for row in found] == [(1_001, None, False)]


def test_an_insertion_can_turn_a_whole_chain(spark, tmp_path):
    """Each row shares its DOI with the next and its title with the one before; a new first row turns all of them."""
    path = str(tmp_path / "kept")
    rows = [("s", n, f"k{n // 2}", f"l{(n + 1) // 2}") for n in range(1, 10)]
    create_kept(spark.createDataFrame(rows, KIND), path, bucket_entries=5)
    new = [("s", 0, "k0", None), ("s", 0, "k0", None)]
    found = insert_kept(spark, path, spark.createDataFrame(new, KIND))
    assert {tuple(row) for row in kept_rows(spark, path).collect()} == walk(rows + new)
    assert found.count() > 5
    again = insert_kept(spark, path, spark.createDataFrame(new, KIND))
    assert again.count() == 0
    assert {tuple(row) for row in kept_rows(spark, path).collect()} == walk(rows + new)


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "kept")
    create_kept(spark.createDataFrame([], KIND), path)
    assert insert_kept(spark, path, spark.createDataFrame([], KIND)).collect() == []
    insert_kept(spark, path, spark.createDataFrame([("s", 1, None, "t"), ("s", 2, None, None)], KIND))
    assert [tuple(row) for row in kept_rows(spark, path).collect()] == [("s", 1)]
