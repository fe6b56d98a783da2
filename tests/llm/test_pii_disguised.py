"""Disguised identifiers that need every rewriting step."""

from __future__ import annotations

import pytest

from factloom.llm import pii


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("ask eight dot eight dot eight dot eight now", "ip"),
        ("host 192 dot 168 dot 10 dot 7", "ip"),
        ("host one nine two dot 168 dot ten dot 7", None),
        ("card 4111 1111 1111 1 one one one", "card"),
        ("mail jane@example dot com", "email"),
        ("mail jane (at) example dot com", "email"),
        ("mail jane (at) mail dot example dot com", "email"),
        ("call plus four four 20 7946 0958", "phone"),
        ("in room 5 192 dot 168 dot 10 dot 7", "ip"),
        ("one or two of 3 apples", None),
    ],
)
def test_disguises(text, kind):
    found = pii.all_spans(text)
    assert [k for k, *_ in found] == ([kind] if kind else [])
    assert all(disguised for *_, disguised in found)


@pytest.mark.parametrize(
    "text",
    [
        "see section 2.0 at python.org", "the year 2020 at nature.com", "co-founder at google.com", "available 24/7 at example.com", "open 9-17 at museum.de", "it costs $5.99 at amazon.com",
        "1999 at example.com", "e.g. at example.com", "find us at example dot com", "U.S. at example.com", "version v2.1 at github.com", "read more at python dot org", "amazon.com at google.com",
        "the co-founder at example dot com", "up 12% at nasdaq.com", "half-price at shop.example.com", "4.5 at imdb dot com", "p.m. at museum.de", "chapter 3.4.1 at docs.python.org",
    ],
)
def test_prose_is_no_address(text):
    assert pii.all_spans(text) == [] and pii._masked(text) == text


@pytest.mark.parametrize("name", ["jane.doe at example.com", "jane at example dot com", "jane dot doe at mail dot example dot com", "j_doe at example.org", "j.doe at example.com", "jane99 at example dot com", "Jane.Doe at mail.example.co"])
def test_bare_addresses_with_their_offsets(name):
    assert [(k, a, b, d) for k, a, b, d in pii.all_spans(f"é write {name} today")] == [("email", 8, 8 + len(name), True)]
