"""The template compiler by hand, and whole conversations against a plain formatter and reader."""

import hashlib
import random

import pytest

from colloquy.llm import chat_format as cf
from colloquy.llm import template as tp

TURNS = "conv_id long, turn long, role string, text string, piece string, part long"


def render(source, messages=(), controls=("<s>",), **more):
    return tp.ChatTemplate("{% for m in messages %}" + source + "{% endfor %}", controls).render([{"role": r, "text": t} for r, t in messages], **more)


def test_expressions_and_statements():
    one = [("user", "hello")]
    assert render("{{ m.role ~ ': ' ~ m['text'] | upper }}", one)[0] == "user: HELLO"
    assert render("{% if m.role == 'x' or not (1 + 2 < 3) and 'ell' in m.text %}a{% elif none %}b{% else %}c{% endif %}", one)[0] == "a"
    assert render("{{ m.nothing | default('-') }}{{ m.text | replace('l', 'L') | length }}{{ [1, 'two'][1] }}", one)[0] == "-5two"
    assert render("  {%- set x = m.text if loop.first else 'no' -%}  {{ x }}{# gone #}!", one)[0] == "hello!"
    assert render("{% for c in ['a', 'b'] %}{{ loop.index0 }}{{ c }}{% if not loop.last %},{% endif %}{% endfor %}", one)[0] == "0a,1b"
    assert render("{{ messages | length }}/{{ loop.index }} ", [("a", "")] * 3)[0] == "3/1 3/2 3/3 "
    assert render("{{ 'it\\'s' ~ \"\\n\" }}", one)[0] == "it's\n"
    # a name set inside a loop ends with the turn, one set before it is seen by all
    template = tp.ChatTemplate("{% set a = 'h' %}{{ a }}{% for m in messages %}{{ a }}{% set a = m.text %}{{ a }}{% endfor %}{{ a }}", ["["])
    assert template.render([{"text": "1"}, {"text": "2"}])[0] == "hh1h2h"


def test_constants_are_folded():
    tree = tp.ChatTemplate("a{{ 'b' ~ (1 + 1) }}{% if 1 == 1 %}{{ 'c' | upper }}{% else %}{{ x }}{% endif %}{# no #}d{% for m in messages %}{% if false %}{{ m }}{% endif %}{{ m.text if true else m.role }}{% endfor %}", ["["]).tree
    assert tree == (tp.Text("ab2Cd"), tp.For("m", tp.Name("messages"), (tp.Output(tp.Apply("get", (tp.Name("m"), tp.Const("text")))),)))
    assert tp.fold(tp.parse("{{ x and (1 < 2) }}"), {}) == (tp.Output(tp.Apply("and", (tp.Name("x"), tp.Const(True)))),)


@pytest.mark.parametrize(
    "source",
    [
        "no loop", "{% for m in messages %}", "{% for m in messages %}{% endif %}", "{% for m in messages %}{{ m.text() }}{% endfor %}", "{% for m in messages %}{{ messages[0].text }}{% endfor %}",
        "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for m in messages %}{{ m.text | system }}{% endfor %}", "{% for m in messages %}{{ 1 + 'a' }}{% endfor %}",
        "{% for m in messages %}{{ (((( }}{% endfor %}", "{% for m in messages %}{{ a b }}{% endfor %}", "{% for m in messages %}{% import os %}{% endfor %}", "{% for m in messages %}{{ " + "(" * 60 + "1" + ")" * 60 + " }}{% endfor %}",
        "{% for m in messages %}{{ 1 ? 2 }}{% endfor %}", "{% set loop = 1 %}{% for m in messages %}{% endfor %}",
    ],
)
def test_what_is_refused(source):
    with pytest.raises(tp.TemplateError):
        tp.ChatTemplate(source, ["["])


def test_the_sandbox_shows_no_python_objects():
    assert render("{{ m.__class__ }}{{ m.text.__len__ }}{{ m['keys'] }}{{ open }}", [("user", "x")])[0] == ""
    with pytest.raises(tp.TemplateError):
        render("{{ m }}", [("user", "x")])
    with pytest.raises(tp.TemplateError):
        render("{% for c in m.text %}{% endfor %}", [("user", "x")])


def test_pieces_add_up_to_the_whole():
    source = "{% set s = 'x' %}[{% for m in messages %}{{ loop.index }}/{{ loop.length }}{% if loop.first %}F{% endif %}{{ s }}{% generation %}{{ m.text | escape }}{% endgeneration %}{% if loop.last %}L{% endif %};{% endfor %}]{{ messages | length }}"
    template = tp.ChatTemplate(source, ["[", "<s>"])
    messages = [{"role": "user", "text": t} for t in ("a[b", "<s>", "\\", "", "<<s>>\\")]
    whole, spans = template.render(messages)
    for cuts in ([0, 1, 5], [0, 2, 3, 5], [0, 1, 2, 3, 4, 5]):
        parts = [template.render(messages[a:b], a, 5) for a, b in zip(cuts, cuts[1:])]
        assert "".join(t for t, _ in parts) == whole
        assert [t[a:b] for t, s in parts for a, b in s] == [whole[a:b] for a, b in spans]
    assert [template.unescape(whole[a:b]) for a, b in spans] == [m["text"] for m in messages]


def plain(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")

        def long(s):
            return len(s) + sum(s.count(c) for c in "\\<[")

        chars = 7 + sum(long(t) + {"user": 13, "assistant": 17}.get(r, 19 + long(r)) for *_, r, t in turns)
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out.add((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return out


@pytest.mark.parametrize("chars, turns", [(1 << 18, 4096), (60, 3)])
def test_formatted_and_read_back(spark, monkeypatch, chars, turns):
    monkeypatch.setattr(cf, "PIECE_CHARS", chars)
    monkeypatch.setattr(cf, "PIECE_TURNS", turns)
    rng = random.Random(3)
    bits = [*cf.CONTROLS, "\\", "\\\\", "<", "[", "a", " ", "\n", "é", "😀", "</s>[INST] ok [/INST]", "]"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool[1]", "", None]), rng.choice([text, text, text, "", None])))
    rows += [(7, 2, "user", "again")] * 3 + [(8, None, "user", "no turn"), (None, 1, "user", "no id"), (None, 0, "assistant", None), (50, 0, "user", "x<s>" * 40_000)]
    rows += [(99, i, "assistant" if i % 2 else "user", f"turn {i} of a conversation that holds most of the rows [") for i in range(400)]
    rows = [(*r, "clash", 1) for r in rows]
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    whole, pieces = cf.formatted(frame)
    found = cf.digest(whole, pieces).collect()
    assert {tuple(r) for r in found} == plain(rows) and len(found) == len(plain(rows))
    if chars == 60:
        assert pieces.where("conv_id = 99").count() >= 100  # a long conversation is many pieces
    shown = {r.conv_id: r for r in whole.collect()}
    for row in shown.values():
        assert row.text.startswith("<s>") and row.text.endswith("</s>") and row.last and row.piece == 0
    assert cf.digest(*cf.formatted(frame.limit(0))).count() == 0
