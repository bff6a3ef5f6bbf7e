"""Chat exports read as tables: long chains, cycles, nesting, and which member counts."""

import json

import pytest

from sparkmeter.sources import chats
from sparkmeter.sources.json_nodes import values


def said(role, text):
    return {"role": role, "content": text}


def node(role, text, parent, children=(), **more):
    return {"message": {"author": {"role": role}, "content": {"parts": [text]}, **more}, "parent": parent, "children": list(children)}


CHAIN = 20_000
DOCS = {
    # a long line of messages of one user, told from the last leaf back
    "chain": ({"mapping": {f"n{i}": node("user", str(i), f"n{i - 1}" if i else None, [f"n{i + 1}"] if i + 1 < CHAIN else []) for i in range(CHAIN)}},
              [("user", "\n\n".join(map(str, range(CHAIN))))]),
    # from d over a, b, c round to d, which ends the way
    "cycle": ({"mapping": {"a": node("user", "a", "b"), "b": node("assistant", "b", "c"), "c": node("user", "c", "d"), "d": node("assistant", "d", "a")}, "current_node": "d"},
              [("user", "c"), ("assistant", "b"), ("user", "a"), ("assistant", "d")]),
    "own parent": ({"mapping": {"a": node("user", "a", "a")}, "current_node": "a"}, [("user", "a")]),
    "branch": ({"current_node": "c2", "mapping": {"r": {"message": None, "parent": None, "children": ["q"]}, "q": node("user", "q", "r", ["c1", "c2"]), "c1": node("assistant", "other", "q"), "c2": node("assistant", "this", "q"), "x": 5}},
               [("user", "q"), ("assistant", "this")]),
    "hidden": ({"current_node": "h", "mapping": {"q": node("user", "q", "gone", ["h"]), "h": node("assistant", "secret", "q", metadata={"is_visually_hidden_from_conversation": True})}}, [("user", "q")]),
    # the first member of an object of no known shape that holds a conversation with a prompt is taken
    "members": ({"a": 1, "b": [[said("assistant", "no prompt")]], "c": {"d": [[said("user", "first")], [said("user", "second")]]}, "e": [said("user", "never")]},
                [("user", "first"), ("user", "second")]),
    "members in members": ([{"x": {"y": [said("user", "1")], "z": [said("user", "not this")]}, "w": [said("user", "nor this")]}, {"v": [said("user", "2")]}], [("user", "1"), ("user", "2")]),
    "last of equal keys": ('{"messages": 3, "messages": [{"role": "user", "role": "human", "content": "old", "content": {"type": "text", "text": "new"}}]}', [("user", "new")]),
    "contents": ({"messages": [
        {"role": "user", "content": [{"type": "image", "text": "no"}, {"type": "text", "text": "a"}, "", ["b", {"content": {"parts": ["c", {"text": "d", "parts": ["e"]}]}}], {"type": "tool", "content": "f"}]},
        {"sender": "ai", "text": "own", "content": "not this"}, {"author": {"role": "user"}, "parts": ["p", 7, None]}, {"message": {"role": "assistant", "content": None, "parts": "w"}}, 3, {"role": 0, "sender": "user", "content": "s"}]},
        [("user", "a\nb\nc\ne\nf"), ("assistant", "own"), ("user", "p"), ("assistant", "w"), ("user", "s")]),
    "not only roles": ([said("user", "no"), {"x": 1}], []),
    "conversation in a conversation": ({"messages": [{"role": "user", "content": "outer", "messages": [said("user", "inner")]}]}, [("user", "outer")]),
    "nothing": ({"messages": []}, []),
    "plain": ('"just text"', []),
}


def test_shapes_chains_and_cycles(spark):
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, (v, _) in DOCS.items()] + [("null", None), ("deep", "[" * 20_000 + json.dumps(said("user", "x")) + "]" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id string, value string").repartition(3)
    got = {}
    for r in chats.parse_documents(df).orderBy("doc_id", "conv_no", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.role, r.text))
    want = {k: v for k, (_, v) in DOCS.items() if v} | {"deep": [("user", "x")]}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "tru", '"a', '["a\nb"]', "[1]]", "{]", "[}", "01", '{1:2}', "[,1]", '"\\x"', "nul"])
def test_what_is_no_json_is_an_error(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        list(values(text))


@pytest.mark.parametrize("text", [" [ 1 , -2.5e3 , true,null ] ", '{"a":{},"b":[]}', '"\\u00e9\\n"', "7", '{"a":{"b":[{"c":"d"},"e"]},"f":"g"}'])
def test_values_and_their_spans(text):
    found = sorted(values(text))
    inside = {n: (n, last) for n, *_, last, _ in found}

    def walk(v, key=None, above=None):
        n = len(order)
        order.append((n, key, above))
        for k, x in v.items() if isinstance(v, dict) else ((None, x) for x in v) if isinstance(v, list) else ():
            walk(x, k, n)
        assert inside[n] == (n, len(order) - 1)

    order = []
    walk(json.loads(text))
    assert [(n, key, up) for n, up, _, key, *_ in found] == order
    for n, _, _, _, _, kind, value, _, size in found:
        if kind in "sx":
            assert size == 0 and isinstance(value, str)
