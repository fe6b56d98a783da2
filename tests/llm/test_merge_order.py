"""The second encoder is used only where it gives the library's ids."""

from __future__ import annotations

import json

from factloom.llm import tokens


def test_merges_out_of_id_order_fall_back(tmp_path):
    path = tokens.vocabulary()
    assert tokens.Encoder(path).fast is not None
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    merges = said["model"]["merges"]
    merges[0], merges[-1] = merges[-1], merges[0]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said), encoding="utf-8")
    assert tokens.Encoder(str(other)).fast is None
