import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import chat
from quillmark.llm.template import TemplateError, compile_template, fold_block, parse
from tests.llm.helpers import clashing

show = lambda source, **env: "".join(t for t, _ in compile_template(source)(**env))


@pytest.mark.parametrize(
    "source,env,wanted",
    [
        ("a{{ x }}b", {"x": 1}, "a1b"),
        ("{% for m in ms %}{{ loop.index }}:{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [{"t": "p"}, {"t": "q"}]}, "1:p,2:q"),
        ("{% if a == 'x' and b > 2 %}1{% elif a %}2{% else %}3{% endif %}", {"a": "x", "b": 3}, "1"),
        ("{% if a == 'x' and b > 2 %}1{% elif a %}2{% else %}3{% endif %}", {"a": "x", "b": 1}, "2"),
        ("{% set y = x + '!' %}{{ y | upper | trim }}", {"x": " hi"}, "HI!"),
        ("{{ x['k'] ~ 1 }}{# note #}{{ 'a\\n' }}", {"x": {"k": "v"}}, "v1a\n"),
        ("{{ 'b' in xs }}{{ xs | length }}{{ missing }}{{ xs[5] }}", {"xs": ["b"]}, "True1"),
        ("{{ (1 + 2) }}{% if 1 == 2 %}no{% else %}yes{% endif %}", {}, "3yes"),
    ],
)
def test_language(source, env, wanted):
    assert show(source, **env) == wanted


def test_constants_are_folded():
    assert fold_block(parse("a{{ 'b' + 'c' }}{% if true %}d{% endif %}{% if false %}{{ x }}{% endif %}e"), {}) == [("text", "abcde")]


@pytest.mark.parametrize("source", ["{{ x.y( }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ }}", "{% exec %}", "{{ 'a' | no }}", "{{ a b }}", "{% endfor %}"])
def test_errors(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_the_sandbox_reaches_no_attributes_or_calls():
    assert show("{{ x.__class__ }}{{ x['__class__'] }}", x="s") == ""
    with pytest.raises(TemplateError):
        compile_template("{{ x.__class__() }}")


def test_loops_draw_items_one_by_one():
    out = compile_template("{% for i in xs %}{% generation %}{{ i }}{% endgeneration %};{% endfor %}")(xs=itertools.count())
    assert list(itertools.islice(out, 4)) == [("0", True), (";", False), ("1", True), (";", False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\<s>/[INST]|turnend\n ", max_size=40))
def test_escapes_are_reversible(text):
    coded = chat.escape(text)
    assert chat.unescape(coded) == text and not any(c in coded for c in chat.CONTROLS)
    line = chat.escape_line(text)
    assert chat.unescape(line) == text and chat._line.match(line)[0] == line


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learn = "".join(r[3] or "" for r in own if r[2] == "assistant")
        size = sum(len(chat.OPEN) + len(chat.escape_line(r[2] or "")) + 1 + len(chat.escape(r[3] or "")) + len(chat.CLOSE) + 1 for r in own)
        out[conv] = (len(own), hashlib.sha256(every.encode()).hexdigest(), len(learn), hashlib.sha256(learn.encode()).hexdigest(), size)
    return out


def test_conversations_against_brute_force(spark, monkeypatch):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 1, "assistant", "second \\ <|end|>\n"), (2, 0, "sys\ntem<s>", "first\n"), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, 0, None, "x"), (4, None, "user", "early"), (4, 0, "user", "\U0001f600"), (5, 0, "assistant", "y" * 200_000)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = chat.format_conversations(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_conversations(parts).collect()}
    assert got == want(rows)
    whole = {}
    for r in parts.collect():
        whole.setdefault(r["conv_id"], []).append(r)
    one = "".join(r["text"] for r in sorted(whole[1], key=lambda r: r["part"]))
    assert one.startswith("<|turn|>user\n<\\/s>") or hard not in one
    spans = [s for r in whole[1] for s in r["learn"]]
    assert "".join(chat.unescape(one[s["start"] : s["end"]]) for s in spans) == hard


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.format_conversations(df)).count() == 0


def test_broken_output_is_refused():
    reader = chat.TurnReader()
    with pytest.raises(ValueError, match="mark"):
        reader.feed("no mark", [])
