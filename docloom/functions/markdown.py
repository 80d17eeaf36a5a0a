"""Markdown-aware text functions: cleaning, sentences, structure, chunks.

Pure functions of one text; ``docloom.operators.text`` runs them over columns in
Arrow batches. They need ordered state over lines, which column expressions lack.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

from docloom.functions.tables import ABBREVIATIONS, ATX_HEADING, CALLOUT, CHUNK_HEADING, CLOSING_MARKS, DEFINITION, FENCE, LIST_ITEM, TABLE_CLOSE, TABLE_OPEN, TABLE_RULE

_ITEM, _RULE = re.compile(LIST_ITEM), re.compile(TABLE_RULE)
_BLANKS = re.compile(r"[ \t]+")


# ---------------------------------------------------------------- cleaning


def _squeeze(text: str) -> str:
    return _BLANKS.sub(" ", text).strip()


def _clean_line(line: str) -> str:
    text = line.strip()
    if head := re.match(r"(#{1,6})\s*(.*)$", text):
        return f"{head[1]} {_squeeze(head[2])}".rstrip()
    if item := _ITEM.match(line):
        width = len(item[1].replace("\t", " " * 4)) & ~1
        return f"{' ' * width}{item[2]} {_squeeze(line[item.end() :])}".rstrip()
    if text.startswith(">"):
        marks = re.match(r"(?:>\s*)+", text)[0]
        return ("> " * marks.count(">") + _squeeze(text[len(marks) :])).rstrip()
    if _RULE.match(text):
        return re.sub(r"\s+", "-", text.replace(" ", ""))
    if "|" in text:
        return f"| {' | '.join(c.strip() for c in text.strip('|').split('|'))} |"
    return _squeeze(text)


def clean_text(value: str) -> str:
    """Normalise white space, headings, lists, quotes and table rows; fenced code keeps its inside."""
    text = textwrap.dedent(value).replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    out: list[str] = []
    code: list[str] | None = None
    for line in text.split("\n"):
        fence = line.strip().startswith("```")
        if code is not None or fence:
            closing = code is not None and fence
            code = [*(code or []), line.rstrip(" \t")]
            if closing:
                out.append("\n".join(code).strip())
                code = None
            continue
        cleaned = _clean_line(line)
        if cleaned or not out or out[-1]:
            out.append(cleaned)
    if code:
        out.append("\n".join(code).strip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out).strip()).strip()


# ---------------------------------------------------------------- sentences

_CLOSERS = re.escape(CLOSING_MARKS)
_END = re.compile(rf"[。！？][{_CLOSERS}]*|[!?][{_CLOSERS}]*(?=\s|\Z)|(?<!\.)\.(?!\.)[{_CLOSERS}]*(?=\s|\Z)")
_TOKEN = re.compile(r"(?:[^\W\d_]|\.)*\Z")
_NEXT = re.compile(r"\W*([^\W\d_]*)")


class Boundaries:
    """What a period may end: no sentence after an abbreviation, unless a capitalised starter comes next."""

    def __init__(self, abbreviations: Collection[str], starters: Collection[str] = ()):
        self.abbreviations, self.starters = frozenset(abbreviations), frozenset(starters)
        self.longest = max(map(len, self.abbreviations), default=0)

    def joins(self, text: str, period: int) -> bool:
        """The period at this place belongs to an abbreviation."""
        token = _TOKEN.search(text, max(0, period - self.longest - 2), period)
        return token[0].lower() in self.abbreviations

    def starts(self, text: str, at: int) -> bool:
        """A known sentence starter, capitalised, comes next."""
        word = _NEXT.match(text, at)[1]
        return word[:1].isupper() and word.lower() in self.starters


HEURISTIC = Boundaries(ABBREVIATIONS)


def sentence_spans(text: str, boundaries: Boundaries = HEURISTIC) -> list[tuple[int, int]]:
    """Spans of the sentences; only white space lies between them."""
    if not text.strip():
        return []
    spans, start = [], 0
    stop = len(text.rstrip())
    for end in _END.finditer(text):
        last = end.end()
        if text[end.start()] == "." and boundaries.joins(text, end.start()) and not boundaries.starts(text, last):
            if end.start() + 1 < stop:
                continue
            last = end.start() + 1
        spans.append((start, last))
        start = last + len(text[last:]) - len(text[last:].lstrip()) if last < len(text) else last
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def sentences(text: str, boundaries: Boundaries = HEURISTIC) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text, boundaries)]


# ---------------------------------------------------------------- structure

MAX_STRUCTURE_BYTES, MAX_SECTIONS = 5_000_000, 10_000
_ATX = re.compile(ATX_HEADING)


@dataclass
class Section:
    id: str
    title: str
    level: int
    parent_id: str | None
    start: int
    end: int
    body: int
    blocks: list[tuple[str, str, str, int, int]] = field(default_factory=list)


def _lines(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, line, role): fence and code lines are marked over the whole text."""
    at, inside = 0, False
    for line in text.split("\n"):
        if line.strip().startswith("```"):
            yield at, line, "close" if inside else "open"
            inside = not inside
        else:
            yield at, line, "code" if inside else "text"
        at += len(line) + 1


def sections(text: str) -> list[Section]:
    """Sections under ATX headings outside fences, with typed blocks; no heading, no section."""
    if len(text.encode()) > MAX_STRUCTURE_BYTES:
        return []
    found: list[Section] = []
    children: dict[str | None, int] = {}
    chain: list[Section] = []
    lines = list(_lines(text))
    for at, line, role in lines:
        head = _ATX.match(line) if role == "text" else None
        if not head:
            continue
        level = len(head[1])
        while chain and chain[-1].level >= level:
            chain.pop()
        parent = chain[-1].id if chain else None
        children[parent] = n = children.get(parent, 0) + 1
        section = Section(f"{parent}-{n}" if parent else f"s-{n}", re.sub(r"\s+", " ", head[2].strip()), level, parent, at, len(text), min(at + len(line) + 1, len(text)))
        if found:
            found[-1].end = at
        chain.append(section)
        found.append(section)
    owner = iter(found)
    now = next(owner, None)
    for kind, start, end in _blocks(lines, found):
        while now and start >= now.end:
            now = next(owner, None)
        if now is None:
            break
        if start >= now.body:
            now.blocks.append((f"b-{now.id}-{len(now.blocks) + 1}", kind, text[start:end], start, end))
    return found[:MAX_SECTIONS]


def _blocks(lines: list[tuple[int, str, str]], found: list[Section]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the blocks in the sections' bodies, and of all fences."""
    bodies = iter([(s.body, s.end) for s in found])
    body = next(bodies, (0, 0))
    open_: tuple[str, int, int] | None = None
    ruled = False
    for at, line, role in lines:
        stripped, end = line.strip(), at + len(line)
        if role != "text":
            if role == "open":
                if open_:
                    yield _settled(open_, ruled)
                open_, ruled = ("fence", at, end), False
            else:
                open_ = ("fence", open_[1], end)
                if role == "close":
                    yield _settled(open_, ruled)
                    open_ = None
            continue
        while at >= body[1] and (following := next(bodies, None)):
            body = following
        inside = body[0] <= at < body[1]
        if not inside or not stripped or _ATX.match(line):
            kind = ""
        elif _ITEM.match(line) or (open_ and open_[0] == "list" and stripped[0] not in ">|"):
            kind = "list"
        else:
            kind = {">": "blockquote", "|": "pipes"}.get(stripped[0], "paragraph")
        if open_ and open_[0] != kind:
            yield _settled(open_, ruled)
            open_, ruled = None, False
        if kind:
            open_ = (kind, open_[1] if open_ else at, end)
            ruled |= kind == "pipes" and bool(_RULE.match(stripped))
    if open_:
        yield _settled(open_, ruled)


def _settled(block: tuple[str, int, int], ruled: bool) -> tuple[str, int, int]:
    kind = {"fence": "code", "pipes": "table" if ruled else "paragraph"}.get(block[0], block[0])
    return kind, block[1], block[2]


# ---------------------------------------------------------------- chunks


@dataclass(frozen=True)
class ChunkOptions:
    max_chars: int = 2000
    overlap: int = 200
    level_step: int = 0
    min_chars: int = 200
    snap: bool = False
    snap_back: int = 2000
    heading_boundary: bool = False


@dataclass
class Chunk:
    text: str
    start: int
    end: int
    metadata: dict[str, str]

    @property
    def verbatim(self) -> bool:
        return "language" in self.metadata or "structure_type" in self.metadata


_HEADING, _FENCE, _DEFINES = re.compile(CHUNK_HEADING, re.M), re.compile(FENCE), re.compile(DEFINITION)
_TABLE_IN, _TABLE_OUT, _CALLOUT = re.compile(TABLE_OPEN, re.I), re.compile(TABLE_CLOSE, re.I), re.compile(CALLOUT)
_ITEMS = re.compile(LIST_ITEM, re.M)


def heading_sections(text: str) -> list[tuple[int, str, dict[str, str]]]:
    """(start, text, heading metadata); text before the first heading has none."""
    heads = list(_HEADING.finditer(text))
    out: list[tuple[int, str, dict[str, str]]] = []
    if not heads or heads[0].start():
        out.append((0, text[: heads[0].start()] if heads else text, {}))
    trail: list[tuple[int, str]] = []
    for head, following in zip(heads, [*heads[1:], None], strict=False):
        level = len(head[0]) - len(head[0].lstrip("#"))
        title = head[0][level:].strip()
        while trail and trail[-1][0] >= level:
            trail.pop()
        meta = {"heading": title, "heading_level": str(level), "heading_path": "/".join([t for _, t in trail] + [title]), "parent_heading": trail[-1][1] if trail else ""}
        trail.append((level, title))
        out.append((head.start(), text[head.start() : following.start() if following else len(text)], meta))
    return out


class _Reader:
    """Takes blocks off the front of a list of lines."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.lines[self.at + ahead] if self.at + ahead < len(self.lines) else None

    def take(self, until) -> str:
        """At least one line, then lines until ``until`` says stop."""
        first = self.at
        self.at += 1
        while (line := self.peek()) is not None and not until(line):
            self.at += 1
        return "\n".join(self.lines[first : self.at])

    def block(self) -> tuple[str, str, dict[str, str]] | None:
        while (line := self.peek()) is not None and not line.strip():
            self.at += 1
        if line is None:
            return None
        stripped = line.strip()
        if fence := _FENCE.match(line):
            return self._code(fence)
        if _TABLE_IN.search(line):
            return "atom", self.take(lambda _: _TABLE_OUT.search(self.lines[self.at - 1])), {"structure_type": "html_table"}
        if stripped.startswith("|"):
            body = self.take(lambda x: not x.strip().startswith("|"))
            table = any(_RULE.match(x.strip()) for x in body.split("\n"))
            return ("atom", body, {"structure_type": "table"}) if table else ("paragraph", body, {})
        if stripped.startswith(">"):
            body = self.take(lambda x: not x.strip().startswith(">"))
            call = _CALLOUT.match(line) or _CALLOUT.match(stripped)
            return "atom", body, {"structure_type": "callout", "callout_type": call[1].lower()} if call and line.startswith(">") else {"structure_type": "blockquote"}
        if _DEFINES.match(line) or _DEFINES.match(self.peek(1) or ""):
            stop = lambda x: not x.strip() or not (_DEFINES.match(x) or x[0] in " \t")
            return "atom", self.take(stop), {"structure_type": "definition_list"}
        kind = "list" if _ITEM.match(line) else "paragraph"

        def other(x: str) -> bool:
            s = x.strip()
            return not s or s[0] in ">|" or bool(_FENCE.match(x) or _TABLE_IN.search(x) or _DEFINES.match(self.peek(1) or "") or (kind == "paragraph" and _ITEM.match(x)))

        return kind, self.take(other), {}

    def _code(self, fence: re.Match) -> tuple[str, str, dict[str, str]]:
        first, mark = self.at, fence[1]
        self.at += 1
        while (line := self.peek()) is not None:
            self.at += 1
            end = _FENCE.match(line)
            if end and end[1][0] == mark[0] and len(end[1]) >= len(mark) and not end[2].strip():
                break
        return "atom", "\n".join(self.lines[first : self.at]), {"language": next(iter(fence[2].split()), "")}


def _gather(parts: list[str], glue: str, budget: int) -> list[str]:
    """Join parts while they fit the budget; a part above it stands alone."""
    out: list[str] = []
    now = ""
    for part in parts:
        if len(now) + len(part) + len(glue) <= budget:
            now = f"{now}{glue}{part}" if now else part
        else:
            if now:
                out.append(now)
            now = part
    return [*out, now] if now else out


def _list_items(block: str) -> list[str]:
    lines = block.split("\n")
    first = _ITEM.match(lines[0])
    base = len(first[1]) if first else 0
    begins = [i for i, x in enumerate(lines) if (m := _ITEM.match(x)) and len(m[1]) == base]
    return ["\n".join(lines[a:b]) for a, b in zip(begins, [*begins[1:], len(lines)], strict=True)]


def _prose(block: str, boundaries: Boundaries) -> list[str]:
    """Sentences of a paragraph; marks inside inline code end none."""
    masked = re.sub(r"`[^`]*`", lambda m: re.sub("[.!?]", "_", m[0]), block)
    return [block[a:b] for a, b in sentence_spans(masked, boundaries)]


def _long_section(text: str, start: int, budget: int, boundaries: Boundaries) -> list[Chunk]:
    reader, out = _Reader(text), []
    pending, at = "", start

    def emit(body: str, meta: dict[str, str]) -> None:
        nonlocal at
        out.append(Chunk(body, at, at + len(body), meta))
        at += len(body)

    while block := reader.block():
        kind, body, meta = block
        if kind != "atom" and len(pending) + len(body) + 2 <= budget:
            pending = f"{pending}\n\n{body}" if pending else body
            continue
        if pending:
            emit(pending, {})
            pending = ""
        if kind == "atom":
            emit(body, meta)
        elif len(body) <= budget:
            pending = body
        else:
            for part in _gather(_list_items(body), "\n", budget) if kind == "list" else _gather(_prose(body, boundaries), " ", budget) or [body]:
                emit(part, {})
    if pending:
        emit(pending, {})
    return out


def _is_structured(line: str) -> bool:
    return bool(_FENCE.match(line)) or line.strip()[:1] in (">", "|", ":") and bool(line.strip()) or bool(_TABLE_IN.search(line))


def _tail(text: str, options: ChunkOptions) -> str:
    cut = max(0, len(text) - options.overlap)
    if options.snap:
        low = max(0, cut - options.snap_back)
        blank = text.rfind("\n\n", low, cut)
        marks = [m.start() for m in _ITEMS.finditer(text, low, cut)] + ([blank + 2] if blank >= 0 else [])
        cut = max(marks, default=cut)
    return text[cut:]


def chunks(text: str, options: ChunkOptions = ChunkOptions(), boundaries: Boundaries = HEURISTIC) -> list[Chunk]:
    """Chunks by headings, then by size; the tail of a prose chunk is put before the next."""
    if not text.strip():
        return []
    out: list[Chunk] = []
    for start, body, meta in heading_sections(text):
        budget = options.max_chars
        if options.level_step > 0:
            budget = max(budget - options.level_step * (int(meta.get("heading_level", 1)) - 1), options.min_chars)
        if len(body) <= budget and not any(map(_is_structured, body.split("\n"))):
            out.append(Chunk(body, start, start + len(body), dict(meta)))
        else:
            out += [Chunk(c.text, c.start, c.end, {**meta, **c.metadata}) for c in _long_section(body, start, budget, boundaries)]
    for c in out:
        c.text = c.text.strip()
    if options.overlap <= 0:
        return out
    plain = [c.text for c in out]
    for i in range(1, len(out)):
        bounded = options.heading_boundary and _HEADING.match(plain[i])
        if not out[i].verbatim and not out[i - 1].verbatim and not bounded:
            out[i].text = _tail(plain[i - 1], options) + plain[i]
    return out

