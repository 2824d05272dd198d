"""Sequence algorithms that have no expression in SQL: diffs, greedy matching, claim splitting, mentions, frames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

from clausegrid.functions.constants import (
    CLAIM_VERBS, COLON_TRANSITIONS, DEFINITE_DETERMINERS, ENUMERATION_INTROS, INTRO_DETERMINERS, INTRO_PHRASES, LIST_ITEM_STARTS, LIST_LOOK_AHEAD, MATCH_THRESHOLD, RANGE_PHRASES, SAME_THRESHOLD,
    SEGMENT_STARTERS, SIMILARITY_STOP_WORDS,
)

_DIFF_TOKEN = re.compile(r"\s+|\w+(?:['’]\w+)*|[^\w\s]+")


def redline(before: str, after: str) -> dict:
    """Segments (operation, text) that turn before into after, and counts of tokens other than white space.

    Runs of white space count as one space, so line breaks are no change.
    """
    a, b = (_DIFF_TOKEN.findall(" ".join((x or "").split())) for x in (before, after))
    segments: list[list[str]] = []
    counts = {"before": sum(not t.isspace() for t in a), "after": sum(not t.isspace() for t in b), "unchanged": 0, "inserted": 0, "deleted": 0}
    blocks = 0
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        blocks += op != "equal"
        pieces = [("equal", a[i:j])] if op == "equal" else [("delete", a[i:j]), ("insert", b[k:m])]
        for kind, part in pieces:
            if not part:
                continue
            counts[{"equal": "unchanged", "delete": "deleted", "insert": "inserted"}[kind]] += sum(not t.isspace() for t in part)
            if segments and segments[-1][0] == kind:
                segments[-1][1] += "".join(part)
            else:
                segments.append([kind, "".join(part)])
    return {"segments": [{"operation": o, "text": t} for o, t in segments], **counts, "blocks": blocks}


def _normal(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())


def similarity(left: str, right: str) -> float:
    """The greater of the character ratio (in this order of arguments) and the overlap of terms."""
    a, b = _normal(left), _normal(right)
    terms = [set(x.split()) - set(SIMILARITY_STOP_WORDS) for x in (a, b)]
    union = terms[0] | terms[1]
    return max(SequenceMatcher(None, a, b).ratio(), len(terms[0] & terms[1]) / len(union) if union else 0.0)


def align(left: list[str], right: list[str]) -> list[dict]:
    """Each left limitation takes its best unused right one; what is left over is added or removed."""
    free, out = list(range(len(right))), []
    for i, text in enumerate(left):
        scored = [(similarity(text, right[j]), -j) for j in free]
        best, at = max(scored, default=(0.0, 0))
        if scored and best >= MATCH_THRESHOLD:
            free.remove(-at)
            out.append({"kind": "shared", "left_index": i, "right_index": -at, "similarity": round(best, 3), "changed": best < SAME_THRESHOLD})
        else:
            out.append({"kind": "removed", "left_index": i, "right_index": None, "similarity": None, "changed": None})
    return out + [{"kind": "added", "left_index": None, "right_index": j, "similarity": None, "changed": None} for j in free]


def _spaced(phrase: str) -> str:
    """A phrase as a pattern that takes any white space between its words."""
    return phrase.replace(" ", r"\s+")


def _any(phrases: list[str]) -> str:
    return "(?:" + "|".join(map(_spaced, phrases)) + ")"


_COLON = re.compile(rf"\b(?:{_any(COLON_TRANSITIONS)}|{_spaced('at least the following')}\b(?:\s+\w+)?)\s*$", re.I)
_LISTING = re.compile(rf"\b{_spaced('at least one of')}\b", re.I)
_LIST_ITEM = re.compile(rf"\s*{_any(LIST_ITEM_STARTS)}\b", re.I)
_MARK = re.compile(r"[():;.]")


def split_claim(text: str) -> list[tuple[int, int]]:
    """Ranges of a claim's segments, without the marks that part them.

    Outside parentheses a semicolon parts, unless it goes on with a listing announced since the last mark or full stop;
    a colon parts behind a transition. Full stops don't.
    """
    cuts, listed_from, depth = [0], 0, 0
    for m in _MARK.finditer(text):
        at, mark = m.span()[0], m[0]
        if mark == "(":
            depth += 1
        elif mark == ")":
            depth -= depth > 0
        elif depth == 0 and mark == ".":
            listed_from = at
        elif depth == 0:
            if mark == ":":
                parts = _COLON.search(text, cuts[-1], at)
            else:
                parts = not (_LISTING.search(text, listed_from, at) and _LIST_ITEM.match(text[at + 1 : at + 1 + LIST_LOOK_AHEAD]))
            if parts:
                cuts.append(at + 1)
                listed_from = at + 1
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])] + [(cuts[-1], len(text))]


_STARTERS = re.compile("|".join(rf"{_spaced(s)}\b" for s in SEGMENT_STARTERS), re.I)


def segments(text: str) -> list[dict]:
    """A claim's segments; offsets are into the text as it came, the first is the preamble."""
    out = []
    for start, end in split_claim(text or ""):
        body = re.sub(r"^and\s+(?=\w)", "", " ".join((text or "")[start:end].split()), flags=re.I)
        if body:
            starter = _STARTERS.match(body)
            out.append({"idx": len(out), "start": start, "end": end, "text": body, "starter": starter[0].lower() if starter else "", "kind": "limitation" if out else "preamble"})
    return out


def _clean(text: str) -> str:
    return " ".join(text.split()).strip(" ,")


def _top_level(text: str, delimiter: str) -> list[str]:
    """Parts between delimiters outside parentheses, trimmed, empty ones dropped."""
    depth, start, parts = 0, 0, []
    for m in re.finditer(rf"[()]|{re.escape(delimiter)}", text, re.I):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= depth > 0
        elif depth == 0:
            parts.append(text[start : m.start()])
            start = m.end()
    return [x for x in map(_clean, [*parts, text[start:]]) if x]


def enumeration(text: str) -> dict | None:
    """Head and items of the listing announced by an enumeration phrase, the longest phrase first; two items at least."""
    flat = " ".join((text or "").split())
    found = [m for phrase in sorted(ENUMERATION_INTROS, key=len, reverse=True) if (m := re.search(rf"\b{phrase}\b", flat, re.I))]
    if not found:
        return None
    head, tail = _clean(flat[: found[0].end()]), _clean(flat[found[0].end() :])
    for written, meant in ((", and ", " and "), (", or ", " or "), (" and/or ", " or ")):
        tail = tail.replace(written, meant)
    items = next((x for d in (" or ", ", ", "; ", " and ") if len(x := _top_level(tail, d)) > 1), [])
    items = [re.sub(r"^(?:and|or)\s+", "", x, flags=re.I).strip(" ,") for x in items]
    return {"head": head, "items": items} if items else None


def core_and_alternatives(text: str) -> tuple[str, list[str]]:
    """What stands before a top-level "or", and the alternatives behind it; a listing has none."""
    parts = _top_level(text, " or ")
    if len(parts) < 2 or enumeration(text):
        return " ".join(text.split()), []
    return parts[0], parts[1:]


def main_requirement(text: str, parts: list[dict]) -> str:
    """A segment without the spans of its leaves."""
    at, out = 0, []
    for x in sorted(parts, key=lambda x: x["start"]):
        out.append(text[at : x["start"]])
        at = x["end"]
    return " ".join("".join([*out, text[at:]]).replace(" ,", ",").replace(" ;", ";").split())


def leaves(text: str) -> list[dict]:
    """Marked parts of a segment by rules: enumerations, grounds, responses, ranges, clauses; else the remainder."""
    found = []

    def end_from(at: int) -> int:
        m = re.search(r"[,;]", text[at:])
        return at + m.start() if m else len(text)

    def add(label: str, start: int, end: int) -> None:
        if text[start:end].strip():
            found.append({"label": label, "start": start, "end": end, "text": text[start:end].strip()})

    for phrase in sorted(ENUMERATION_INTROS, key=len, reverse=True):
        for m in re.finditer(r"\b" + phrase.replace(" ", r"\s+") + r"\b", text, re.I):
            end = len(text) if text[m.end() :].count(",") else end_from(m.end())
            if re.search(r",|\bor\b|\band\b", text[m.end() : end]) and not any(x["start"] <= m.start() < x["end"] for x in found):
                add("enumeration", m.start(), end)
    for label, pattern in (("based on", r"\bbased\b[\w\s]{0,30}?\bon\b"), ("in response to", r"\b(?:in\s+)?response\s+to\b")):
        for m in re.finditer(pattern, text, re.I):
            add(label, m.start(), end_from(m.end()))
    for phrase, delimiter in sorted(RANGE_PHRASES, key=lambda x: -len(x[0])):
        for m in re.finditer(r"\b" + phrase.replace(" ", r"\s+") + r"\b", text, re.I):
            end = end_from(m.end())
            if delimiter in text[m.end() : end] and not any(x["start"] <= m.start() and end <= x["end"] for x in found):
                add("range", m.start(), end)
    for phrase in ("such that", "wherein", "whereby"):
        for m in re.finditer(r"\b" + phrase.replace(" ", r"\s+") + r"\b", text, re.I):
            add(phrase, m.start(), len(text) if phrase == "such that" and "at least one of" in text[m.end() :].lower() else end_from(m.end()))
    found.sort(key=lambda x: (x["start"], x["start"] - x["end"]))
    kept: list[dict] = []
    for x in found:
        same = [k for k in kept if k["label"] == x["label"] and k["end"] > x["start"]]
        if not same:
            kept.append(x)
    at, rest = 0, []
    for x in [*kept, {"start": len(text), "end": len(text)}]:
        gap = text[at : x["start"]].strip(" ,;:.")
        if len(gap) >= 6:
            begin = text.index(gap, at)
            rest.append({"label": "remainder", "start": begin, "end": begin + len(gap), "text": gap})
        at = max(at, x["end"])
    return sorted(kept + rest, key=lambda x: (x["start"], x["end"]))


def _verb(word: str) -> str:
    """Plain verb of a word in -ing, -s or -ed, by rule."""
    w = word.lower()
    for end, put in (("ing", ""), ("ing", "e"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e")):
        if w.endswith(end) and w[: -len(end)] + put in CLAIM_VERBS:
            return w[: -len(end)] + put
    if w in CLAIM_VERBS or not w.endswith("ing"):
        return w
    stem = w[:-3]
    if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if re.search(r"[aeiou][^aeiouwxy]$", stem) and not re.search(r"[aeiou]{2}[^aeiou]$|[^aeiou]e[nrl]$|it$", stem) else stem


def is_verb(word: str) -> bool:
    """Whether a word is a form of one of the claim verbs."""
    return _verb(word) in CLAIM_VERBS


def action_frame(text: str) -> dict:
    """Leading verb, its object, alternatives and leaves of a segment, by rules."""
    core, alternatives = core_and_alternatives(text)
    words = re.findall(r"[\w'-]+", re.sub(r"^(?:and|or|wherein|whereby)\s+", "", core, flags=re.I))
    verbs = [i for i, w in enumerate(words) if is_verb(w) or w.lower().endswith("ing")]
    anchor = _verb(words[verbs[0]]) if verbs else "(no-verb)"
    after = words[verbs[0] + 1 :] if verbs else words
    obj: list[str] = []
    for w in after:
        if w.lower() in ("of", "in", "on", "with", "for", "from", "to", "by", "at", "and", "or", "when", "that", "wherein"):
            break
        obj.append(w)
    return {"anchor_verb": anchor, "object_np": " ".join(obj) or None, "core_text": core.strip(), "or_alternatives": alternatives, "leaves": (found := leaves(text)), "main_requirement": main_requirement(text, [x for x in found if x["label"] != "remainder"])}


def graph(text: str) -> dict:
    """Nodes (id, segment, kind, label) and edges (source, target) of a claim: limitation, action, object, leaves and their items, alternatives."""
    nodes, edges = [], []

    def add(parent: str | None, segment: int, kind: str, label: str) -> str:
        name = f"n{len(nodes)}"
        nodes.append({"id": name, "segment": segment, "kind": kind, "label": label})
        if parent is not None:
            edges.append({"source": parent, "target": name})
        return name

    for s in segments(text):
        f = action_frame(s["text"])
        action = add(add(None, s["idx"], s["kind"], s["text"]), s["idx"], "action", f["anchor_verb"])
        if f["object_np"]:
            add(action, s["idx"], "object", f["object_np"])
        for x in f["leaves"]:
            leaf = add(action, s["idx"], x["label"], x["text"])
            for item in (enumeration(x["text"]) or {"items": []})["items"] if x["label"] == "enumeration" else []:
                add(leaf, s["idx"], "item", item)
        for x in f["or_alternatives"]:
            add(action, s["idx"], "or", x)
    return {"nodes": nodes, "edges": edges}


def highlights(marks: list[tuple[int, int]]) -> list[bool]:
    """Which of the spans (start, end) are shown: from the left, the longer first, none that overlaps one before it."""
    shown, reached = [False] * len(marks), -1
    for i in sorted(range(len(marks)), key=lambda i: (marks[i][0], -marks[i][1])):
        if marks[i][0] >= reached:
            shown[i], reached = True, marks[i][1]
    return shown


#: A noun phrase by rule: a determiner or intro phrase, then words up to a verb, preposition or mark.
_DETERMINERS = "|".join([*(p.replace(" ", r"\s+") for p in INTRO_PHRASES), *INTRO_DETERMINERS, *DEFINITE_DETERMINERS])
_MENTION = re.compile(rf"\b({_DETERMINERS})\s+((?:[A-Za-z][\w-]*\s*){{1,6}})", re.I)
_STOP = re.compile(
    r"^(?:of|in|on|with|for|from|to|by|at|and|or|when|that|which|wherein|whereby|is|are|was|were|be|being|has|have|having|exceeds|comprising|comprises|configured|coupled|based|into|through|than|as|if|the|said|an?)$", re.I
)


_WORD = re.compile(r"[A-Za-z][\w-]*")
_WORD_AFTER = re.compile(r"\s*[A-Za-z]")
_CONNECTOR = re.compile(r"[,;]|\band\b|\bor\b", re.I)
_COMPRISING = re.compile(r"\s+comprising\b", re.I)
#: Modifiers that describe by their ending, and nouns with such an ending; other modifiers are nouns of a compound.
_DESCRIBES = re.compile(r"(?:ed|ing|al|ive|ous|ic|able|ible|ful|less|ary|(?<!m)ent|ant)$")
_NOUNS = frozenset("signal terminal metal material crystal journal manual interval animal chemical drive fabric traffic logic music cable table boundary library content component current agent patient event gradient coolant plant vent building bearing spring ring string wing housing coating opening feed seed speed bed".split())
_ADJECTIVES = frozenset("first second third fourth new old same other another each such own main upper lower inner outer left right top bottom front rear high low large small long short hot cold wet dry".split())
#: Words that no bare noun phrase holds.
_NO_NOUN = frozenset(
    "it its they them their he she this these those there here which who whose what where while whenever during before after upon between over under above below within without via per not no nor but so then than also"
    " each any all both either least more most one such where whereas herein thereof therein said same other can may will shall would could should do does did has had least claim claims".split()
)


def _lemma(word: str) -> str:
    w = word.lower()
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _describes(word: str) -> bool:
    return _lemma(word) not in _NOUNS and (word.lower() in _ADJECTIVES or bool(_DESCRIBES.search(word.lower())))


class _Word(NamedTuple):
    """What a word does in a noun phrase."""

    lemma: str
    describes: bool
    #: Ends any phrase; ends one that has begun; parts bare phrases.
    stops: bool
    cuts: bool
    parts: bool
    #: Doesn't begin a bare phrase; nor does it right behind the mention before it.
    governs: bool
    goes_on: bool


def _word_of(word: str) -> _Word:
    w, lemma, stops = word.lower(), _lemma(word), bool(_STOP.match(word))
    no_noun, other = w in _NO_NOUN, lemma not in _NOUNS
    return _Word(lemma, _describes(word), stops, w.endswith(("ing", "ed")) or no_noun, stops or no_noun or w.endswith("ly"), other and (w.endswith("ing") or w in CLAIM_VERBS), other and w.endswith("ed"))


_short_word = lru_cache(20_000)(_word_of)


def _word(word: str) -> _Word:
    return _short_word(word) if len(word) <= 40 else _word_of(word)


def _key(words: list[_Word]) -> str:
    """The nouns that modify the head, sorted and distinct, and the head."""
    return " ".join([*sorted({w.lemma for w in words[:-1] if not w.describes}), words[-1].lemma]) if len(words) > 1 else words[0].lemma


def _opens(text: str, at: int) -> bool:
    """Whether nothing, or a mark, stands before a place, blanks aside."""
    while at and text[at - 1].isspace():
        at -= 1
    return not at or text[at - 1] in ".;:,"


#: kind (intro, ref, bare), text, key (nouns that modify the head, and the head), start, end.
Mention = tuple[str, str, str, int, int]


def _phrase(text: str, start: int, run: list[tuple[int, int, _Word]]) -> Mention | None:
    first, behind = run[0][0], run[-1][1]
    at, n = 0, len(run)
    # A participle or verb that governs the phrase, or goes on from the mention before it.
    while at < n and (run[at][2].governs or run[at][2].goes_on and start and run[at][0] - start <= 1):
        at += 1
    # The verb of a clause that the phrase begins: "Coolant flows through".
    if n - at > 1 and text[behind - 1] == "s" and text[behind - 2 : behind] != "ss" and _opens(text, first) and _WORD_AFTER.match(text, behind):
        n -= 1
    if at == n or run[n - 1][2].describes:
        return None
    a, b = run[at][0], run[n - 1][1]
    return "bare", text[a:b], _key([w for _, _, w in run[at:n]]), a, b


def _bare(text: str, start: int, end: int) -> Iterator[Mention]:
    """Noun phrases without a determiner between start and end: runs of words that no mark, number or function word parts."""
    run, last = [], start
    for w in _WORD.finditer(text, start, end):
        a, b = w.span()
        between, word = text[last:a], _word(w[0])
        last = b
        if run and (word.parts or between != " " and between.strip()):
            if found := _phrase(text, start, run):
                yield found
            run = []
        if not word.parts:
            run.append((a, b, word))
    if run and (found := _phrase(text, start, run)):
        yield found


def each_mention(text: str, bare: bool = True) -> Iterator[Mention]:
    """Noun phrases in order; without the bare ones if these aren't asked for."""
    at = gap = 0
    while m := _MENTION.search(text, at):
        at = m.end(1)
        words, behind = [], 0
        for w in _WORD.finditer(m[2]):
            word = _word(w[0])
            if word.stops or words and word.cuts:
                break
            words.append(word)
            behind = w.end()
        if not words:
            continue
        end = m.start(2) + behind
        if bare:
            yield from _bare(text, gap, m.start())
        gap = at = end
        det = " ".join(m[1].lower().split())
        if det in DEFINITE_DETERMINERS and _COMPRISING.match(text, end):
            continue
        yield "ref" if det in DEFINITE_DETERMINERS else "intro", text[m.start() : end], _key(words), m.start(), end
    if bare:
        yield from _bare(text, gap, len(text))


def mentions(text: str) -> list[dict]:
    return [dict(zip(("kind", "text", "key", "start", "end"), m)) for m in each_mention(text)]


def _judged(text: str) -> tuple[list[Mention], list[str | None], set[str]]:
    """(mentions, severity of each: high of definite phrases without an earlier introduction, info of introductions never referred to; keys that are referred to)."""
    found, severity = list(each_mention(text)), []
    introduced, first, used = set(), {}, set()
    for i, (kind, _, key, _, _) in enumerate(found):
        severity.append("high" if kind == "ref" and key not in introduced else None)
        if kind != "ref":
            introduced.add(key)
            if kind == "intro":
                first.setdefault(key, i)
        elif key in introduced:
            used.add(key)
    for key, i in first.items():
        if key not in used:
            severity[i] = "info"
    return found, severity, used


def issues(text: str) -> Iterator[tuple[int, str, str, str]]:
    """seq, severity, text, key of the mentions with an issue."""
    found, severity, _ = _judged(text)
    for i, x in enumerate(severity):
        if x:
            yield i, x, found[i][1], found[i][2]


def marks(text: str) -> Iterator[tuple[int, int, int, str, str]]:
    """mark (from 0), start, end, label, text of the mentions; of those that overlap the first and longest."""
    found, severity, used = _judged(text)
    n, reached = 0, -1
    for start, back, label, said in sorted((a, -b, ("REF w/o INTRO" if x else "REF ok") if kind == "ref" else "INTRO used" if key in used else "INTRO never ref", said) for (kind, said, key, a, b), x in zip(found, severity)):
        if start >= reached:
            yield n, start, -back, label, said
            n, reached = n + 1, -back


def enumerations(text: str, gap: int = 150) -> Iterator[tuple[int, list[str]]]:
    """island (from 1), texts of each run of two or more introductions with a connector and at most `gap` characters between."""
    island, members, last = 0, [], None
    for kind, said, _, start, end in each_mention(text, bare=False):
        if kind != "intro":
            continue
        if last is None or start - last > gap or not _CONNECTOR.search(text[last:start]):
            if len(members) > 1:
                yield island, members
            island, members = island + 1, []
        members.append(said)
        last = end
    if len(members) > 1:
        yield island, members


class Batcher:
    """Batch number of each item in order: a batch is closed by size, by time since its first item, or by an item that would exceed the budget, which opens the next."""

    def __init__(self, size: int, budget: float, window: float) -> None:
        self.size, self.budget, self.window = size, budget, window
        self.batch, self.count, self.cost, self.opened = -1, 0, 0.0, 0.0

    def take(self, arrival: float, cost: float) -> int:
        if self.batch < 0 or self.count >= self.size or arrival > self.opened + self.window or self.cost + cost > self.budget:
            self.batch, self.count, self.cost, self.opened = self.batch + 1, 0, 0.0, arrival
        self.count, self.cost = self.count + 1, self.cost + cost
        return self.batch


def batches(items: list[tuple[float, float]], size: int, budget: float, window: float) -> list[int]:
    own = Batcher(size, budget, window)
    return [own.take(*x) for x in items]
