from __future__ import annotations

import pytest

from docloom.functions import markdown as M
from docloom.operators.text import find_entities


def test_clean_text_keeps_structure():
    raw = "\n##     Harbour    Rules\n\n\n\nBoats   that  leave\tearly   pay less.\n"
    assert M.clean_text(raw) == "## Harbour Rules\n\nBoats that leave early pay less."
    assert M.clean_text("-   rope      coil\n   - inner    rope\n1.    anchor") == "- rope coil\n  - inner rope\n1. anchor"
    assert M.clean_text(">>       twice      said") == "> > twice said"
    code = "text\n```python\nx   =  1   \n```\nmore"
    assert M.clean_text(code) == "text\n```python\nx   =  1\n```\nmore"
    assert M.clean_text("a|b|c") == "| a | b | c |"
    assert M.clean_text("| a |\n| --- | --- |") == "| a |\n|---|---|"
    assert M.clean_text("#foo") == "# foo"
    assert M.clean_text("") == "" and M.clean_text(" \n\t\n") == ""
    assert M.clean_text("```\nopen  code") == "```\nopen  code"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Nets dry. Gulls wait.", ["Nets dry.", "Gulls wait."]),
        ("潮。風。", ["潮。", "風。"]),
        ("Mrs. Lane sailed for Cork. She was back by 7:30 p.m.", ["Mrs. Lane sailed for Cork.", "She was back by 7:30 p.m."]),
        ("The U.N. met.", ["The U.N. met."]),
        ("It cost 4.20 or 5.75 a pound.", ["It cost 4.20 or 5.75 a pound."]),
        ('Tom called, "Cast off." The rope fell.', ['Tom called, "Cast off."', "The rope fell."]),
        ("Land! Is it near? Quite.", ["Land!", "Is it near?", "Quite."]),
        ("Hold on... now? not yet", ["Hold on... now?", "not yet"]),
        ("   ", []),
        ("", []),
    ],
)
def test_sentences(text, expected):
    assert M.sentences(text) == expected


@pytest.mark.parametrize("text", ["  A. B.", "x.y z! 'q' \"r.\" s", "Hi.  \n There?! Ok", "etc. etc. and so on e.g. this. End"])
def test_sentence_spans_leave_only_white_space(text):
    at = 0
    for a, b in M.sentence_spans(text):
        assert not text[at:a].strip()
        at = b
    assert not text[at:].strip()


DOC = """Preamble.

# First

Paragraph one
goes on.

- item
  more
* second

> quote

```py
# no heading
```

| a | b |
| --- | --- |
| 1 | 2 |

| lone |

## Child
### Deep
# Second
"""


def test_sections_and_blocks():
    found = M.sections(DOC)
    assert [(s.id, s.title, s.level, s.parent_id) for s in found] == [("s-1", "First", 1, None), ("s-1-1", "Child", 2, "s-1"), ("s-1-1-1", "Deep", 3, "s-1-1"), ("s-2", "Second", 1, None)]
    assert [b[1] for b in found[0].blocks] == ["paragraph", "list", "blockquote", "code", "table", "paragraph"]
    for s in found:
        for _, _, body, a, b in s.blocks:
            assert DOC[a:b] == body
    assert M.sections("no heading") == [] and M.sections("") == []
    assert M.sections("```\n# x\n```") == []


def test_level_skip_has_the_nearest_lower_parent():
    found = M.sections("# A\n### C\n## B\n")
    assert [(s.title, s.parent_id) for s in found] == [("A", None), ("C", "s-1"), ("B", "s-1")]


def test_chunks_by_heading_and_overlap():
    text = "intro\n# A\n" + "word " * 30 + "\n## B\nbody"
    got = M.chunks(text, M.ChunkOptions(overlap=5))
    assert [c.metadata.get("heading_path") for c in got] == [None, "A", "A/B"]
    assert got[0].text == "intro" and got[1].text.startswith("intro# A") and got[2].text.endswith("## B\nbody")
    assert text[got[1].start : got[1].end].strip() == "# A\n" + ("word " * 30).strip()
    assert M.chunks("  \n") == []


def test_chunks_keep_structure_whole():
    code = "```python\n" + "x = 1\n" * 600 + "```"
    got = M.chunks(f"# T\n\npara\n\n{code}\n\nafter")
    kinds = [c.metadata.get("language") for c in got]
    assert kinds == [None, "python", None] and got[1].text == code and got[2].text == "after"
    table = M.chunks("| a | b |\n| --- | --- |\n| 1 | 2 |")
    assert table[0].metadata == {"structure_type": "table"}
    assert M.chunks("> [!NOTE] hi\n> there")[0].metadata == {"structure_type": "callout", "callout_type": "note"}
    assert M.chunks("Term\n: meaning")[0].metadata == {"structure_type": "definition_list"}
    assert M.chunks("| a |\n| b |")[0].metadata == {}


def test_long_paragraphs_split_at_sentences_and_lists_at_items():
    para = "This is a sentence of some length. " * 100
    got = M.chunks(para, M.ChunkOptions(overlap=0))
    assert all(len(c.text) <= 2000 and c.text.endswith(".") for c in got) and len(got) == 2
    items = "\n".join(f"- item {i} " + "y" * 90 for i in range(60))
    parts = M.chunks(items, M.ChunkOptions(overlap=0))
    assert all(c.text.startswith("- item") for c in parts) and "\n".join(c.text for c in parts) == items


def test_adaptive_budget_and_snap():
    text = "### Deep\n" + "One two three. " * 60
    assert max(len(c.text) for c in M.chunks(text, M.ChunkOptions(max_chars=800, overlap=0, level_step=200))) <= 400
    tail = M._tail("first para\n\nsecond para is here", M.ChunkOptions(overlap=5, snap=True))
    assert tail == "second para is here"


def test_entities():
    ids = {e[0] for e in find_entities("Dr. Jane Smith at Acme Corporation presented Python 3.12 in Berlin.")}
    assert ids == {"person::jane_smith", "organization::acme_corporation", "technology::python_3.12", "place::berlin"}
    assert find_entities('Cited "Attention Is All You Need" (2017).')[0][2] == "paper"
    assert find_entities("Deep Neural Networks")[0][2] == "concept"
    assert {e[2] for e in find_entities("Schmidt GmbH in Berlin")} == {"organization", "place"}
    assert find_entities("") == []
