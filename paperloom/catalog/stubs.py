"""Deterministic stand-ins for the model: pure functions of the prompt that also fail, babble and leave fields out."""

from __future__ import annotations

import json
from hashlib import md5


def _answer(prompt: str, good: dict, partial: dict) -> str:
    length = len(prompt)
    if length % 11 == 0:
        raise RuntimeError("model unavailable")
    if length % 7 == 0:
        return "not json"
    return json.dumps(partial if length % 5 == 0 else good, ensure_ascii=False)


def summary_stub(prompts: list[str]) -> list[str]:
    def one(prompt: str) -> str:
        digest = md5(prompt.encode()).hexdigest()
        good = {
            "tldr": f"digest {digest}",
            "problem": f"{len(prompt)} characters",
            "method_explained": "hashing",
            "key_results": digest[:8],
            "limitations": "none",
        }
        return _answer(prompt, good, {"tldr": "only", "problem": "", "method_explained": 5, "key_results": None})

    return [one(prompt) for prompt in prompts]


def entity_stub(prompts: list[str]) -> list[str]:
    def one(prompt: str) -> str:
        digest = md5(prompt.encode()).hexdigest()
        good = {"methods": [f" M{digest[:2]} ", f"M{digest[:2]}", "", 7, "Hashing"], "datasets": [f"D{digest[2:4]}"]}
        return _answer(prompt, good, {"methods": "no list", "datasets": ["  Z ", "A"]})

    return [one(prompt) for prompt in prompts]


def gap_stub(prompts: list[str]) -> list[str]:
    def one(prompt: str) -> str:
        digest = md5(prompt.encode()).hexdigest()
        return _answer(prompt, {"method_gaps": [f"m {digest}", "m"], "dataset_gaps": [f"d {len(prompt)}"]}, {"dataset_gaps": []})

    return [one(prompt) for prompt in prompts]


def draft_stub(prompts: list[str]) -> list[str]:
    def one(prompt: str) -> str:
        return _answer(prompt, {"paragraph": f"see {md5(prompt.encode()).hexdigest()}"}, {"text": "no paragraph"})

    return [one(prompt) for prompt in prompts]
