"""Exact source offsets of disguised identifiers, prose left alone, and linear time."""

from __future__ import annotations

import time

import pytest

from factloom.llm.pii import all_spans

DISGUISED = [
    ("mail jane [at] example [dot] com now", "email", "jane [at] example [dot] com"),
    ("mail jane.doe at example.com now", "email", "jane.doe at example.com"),
    ("mail jane at example dot com now", "email", "jane at example dot com"),
    ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
    ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ("call plus four four two zero seven nine four six zero nine five eight please", "phone", "plus four four two zero seven nine four six zero nine five eight"),
]


@pytest.mark.parametrize(("text", "kind", "shown"), DISGUISED)
def test_exact_offsets(text, kind, shown):
    start = text.index(shown)
    assert (kind, start, start + len(shown), True) in all_spans(text)


@pytest.mark.parametrize("text", ["look at e.g", "arrived at approx.ten", "sold at 3.50", "we met at example.org", "one or two at a time. dot", "at five dot five percent"])
def test_prose_is_left_alone(text):
    assert all_spans(text) == []


@pytest.mark.parametrize("make", [lambda n: " " * n + "[at]", lambda n: "x" + " " * n + "at b dot com", lambda n: "a@b.de " * n + "j [at] k [dot] de", lambda n: "[ " * n + "[at]"])
def test_time_is_linear(make):
    def took(n: int) -> float:
        text, best = make(n), 1e9
        for _ in range(3):
            begun = time.process_time()
            all_spans(text)
            best = min(best, time.process_time() - begun)
        return best

    assert took(40_000) <= 3 * took(20_000) + 0.05
