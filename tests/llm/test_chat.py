import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clusterscope.llm import chat

NASTY = ["", " ", "\\", "\\\\", "###", "####", "### ", "\\### Assistant: </turn> ok", "</turn>", "</turn>\n### user: hi</turn>", ": ", ":", "a: b", "</", "turn>",
         "\n", "日本 ### é", "#", "{{ x }}", "{% if %}", "\\\n", "</turn", "::", "\U0001f600</turn>"]


def test_escaping_is_reversible():
    rng = random.Random(1)
    for text in NASTY + ["".join(rng.choice(NASTY) for _ in range(rng.randrange(8))) for _ in range(2000)]:
        assert chat.unescape(chat.escape(text)) == text


def test_turns_and_spans_come_back():
    rng = random.Random(2)
    render = chat.compile_template(chat.TEMPLATE)
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "", "a: b", "x\n", "assistant: "]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(4))))
                 for _ in range(rng.randrange(6))]
        text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_language():
    run = lambda t, **v: chat.compile_template(t)(v)[0]
    assert run("a{{ 'b' ~ 1 }}c") == "ab1c"
    assert run("{% for x in xs %}{{ loop.index0 }}{% if loop.first %}F{% elif loop.last %}L{% else %}-{% endif %}{{ x.k | upper }}{% endfor %}",
               xs=[{"k": "a"}, {"k": "b"}, {"k": "c"}]) == "0FA1-B2LC"
    assert run("{% set y = 'q' if a == 'x' and not b else 'z' %}{{ (y) | upper }}", a="x", b="") == "Q"
    assert run("{{ a or 'none' }}{{ a != 'x' }}", a="") == "noneTrue"
    text, spans = chat.compile_template("x{% generation %}ab{{ t }}{% endgeneration %}y{% generation %}{% endgeneration %}")({"t": "é"})
    assert (text, spans) == ("xabéy", [(1, 4), (5, 5)])


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{{ 'd' ~ 'e' }}{% else %}{{ x }}{% endif %}f"))
    assert tree == chat.Block([chat.Put(chat.Const("aBcdef"))])


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ missing }}", "{{ x | open }}", "{{ x() }}", "{% import os %}", "{% if x %}", "{{ x[0] }}",
                                 "{% for y in x %}{% endfor %}", "{{ 'a' if x }}", "{{ }}", "{{ d }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)({"x": "text", "d": {}})


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 5, "user", "x"), (3, None, "assistant", "y"),
            (3, 0, "assistant", "</turn>"), (1, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, 2: 1, 3: 2, None: 1}
    assert got[1].turns_sha256 == digest("system\ns\nuser\na\nassistant\nb\nassistant\nb\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, digest("bb"))
    assert got[2].turns_sha256 == digest("\n\n") and got[3].loss_sha256 == digest("y</turn>")
    assert chat.format_conversations(df.limit(0)).count() == 0
