import uuid
from pathlib import Path

from paperloom.operators.answers import answer_prompts, create_answers


def counting(folder):
    """A model that notes every prompt it gets, and fails on some."""

    def model(prompts):
        Path(folder, uuid.uuid4().hex).write_text("\n".join(prompts))
        if any("bad" in prompt for prompt in prompts):
            raise RuntimeError("no")
        return [f"re {prompt}" for prompt in prompts]

    return model


def asked(folder):
    return sorted(prompt for file in Path(folder).iterdir() for prompt in file.read_text().split("\n"))


def test_equal_prompts_are_asked_once(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    path = str(tmp_path / "answers")
    create_answers(spark, path)
    rows = [(n, "same") for n in range(1_000)] + [(1_000, "other"), (1_001, None), (1_002, "")]
    prompts = spark.createDataFrame(rows, "id int, prompt string").repartition(7)
    found = {row.id: (row.raw_response, row.error, row.reused) for row in answer_prompts(prompts, counting(first), ["id"], path).collect()}
    assert asked(first) == ["", "other", "same"]
    assert len(found) == 1_003 and found[1_001] == (None, "no prompt", False)
    assert {found[n] for n in range(1_000)} == {("re same", None, False)} and found[1_002] == ("re ", None, False)
    more = spark.createDataFrame([(1, "same"), (2, "bad"), (3, "new"), (4, "bad")], "id int, prompt string")
    found = {row.id: (row.raw_response, row.error, row.reused) for row in answer_prompts(more, counting(second), ["id"], path, batch_size=1).collect()}
    assert asked(second) == ["bad", "new"]
    assert found == {1: ("re same", None, True), 2: (None, "no", False), 3: ("re new", None, False), 4: (None, "no", False)}
    third = tmp_path / "third"
    third.mkdir()
    answer_prompts(more, counting(third), ["id"], path, batch_size=1)
    assert asked(third) == ["bad"]
