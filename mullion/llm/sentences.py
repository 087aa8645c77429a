"""Sentence boundaries across languages and scripts.

Method: a linear-chain model tags every character as boundary (a sentence ends after it) or inside, decoded by Viterbi.
Characters at which no sentence can end have the tag inside for certain, so that the chain is evaluated at the others
only: runs of stops with the closing marks after them; blanks between letters of scripts that put blanks between
sentences (Thai, Lao, Khmer, Burmese); and, in Chinese and Japanese units without any stop, blanks between letters and
the places after kana or final particles. Weights are trained here, by the averaged structured perceptron on composed
paragraphs (sentence_seed); those of the scripts without stops have their stops stripped.

What is known of a place is one small tuple; its features and their weights are added up once per tuple, since a few
thousand tuples cover all texts. Blank lines and line ends before list items end a unit for certain; a unit that is no
prose, told by the forms of its words, is one sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mullion.llm.sentence_lexicon import ABBREVIATIONS, BEFORE_ORDINAL, CALENDAR, GOES_ON, REPORTING, STARTERS
from mullion.llm.sentence_seed import paragraphs

#: Composed paragraphs to train on, and passes over them.
TRAINING_PARAGRAPHS, EPOCHS = 8000, 5

#: Characters that may end a sentence, of all scripts: the full stop, the ellipsis, the others. Fixed values of Unicode.
DOTS, ASKING = ".…．", "!?！？؟‼⁇⁈⁉፧՜՞⸮﹖﹗"
FULL = "。｡।॥۔։።፨။។៕᙮᠃᠉᱾᱿꓿꘎꛳꩝꩞꩟෴჻︒﹒።"
STOPS = "".join(dict.fromkeys(DOTS + ASKING.replace("՜", "").replace("՞", "") + FULL))
OPENERS = {"(": ")", "（": "）", "[": "]", "【": "】", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "｢": "｣", '"': '"', "»": "«", "‹": "›"}
CLOSERS = set(")）]】”“»«」』｣›\"’'")
BRACKETS = set("(（[【")

_SPACE = r"[^\S\n\r\u0085  ]"
_END = r"(?:\r\n|[\n\r\u0085  ])"
_PARAGRAPH = re.compile(rf"{_END}(?:{_SPACE}*{_END})+")
_LINE = re.compile(_END)
_ITEM = re.compile(r"\s*(?:([-*•‣◦▪·])|\(?(\d{1,3}|[٠-٩]{1,3}|[०-९]{1,3}|[a-z])([.)）、]))(?=\s)")
_HEAD = re.compile(r"\s*(?:[-*•‣◦▪·#]+|\(?(?:\d+(?:\.\d+)*|[٠-٩]+|[०-९]+)[.)）]?)(?=\s)")
#: Letters of scripts that put no blanks between words.
_RUN_ON = "ก-ฺเ-๎ກ-ຽເ-ໍໜ-ໟက-ဿၐ-ႏក-៓ៗ-៝"
_HAN, _KANA = "㐀-䶿一-鿿豈-﫿", "ぁ-ゖゝゞァ-ヺー-ヿｦ-ﾝ"
_STOP_RUN = re.compile(rf"[{re.escape(STOPS)}]+")
_MARK = re.compile(rf"[{re.escape(STOPS)}(（\[【“”„«»「」『』｢｣‹›\")）\]】]")
_MARK_RUN_ON = re.compile(_MARK.pattern + rf"|(?<=[{_RUN_ON}])\s+(?=[{_RUN_ON}])")
_HAS_RUN_ON = re.compile(f"[{_RUN_ON}]")
_HAS_CJK = re.compile(f"[{_HAN}{_KANA}]")
_PAIRED = re.compile("[(（\\[【“”„«»「」『』｢｣‹›\"]")
#: Where a Chinese or Japanese sentence may end that has no stop.
_UNMARKED = re.compile(rf"(?<=[{_HAN}{_KANA}])\s+(?=[{_HAN}{_KANA}])|(?<=[ぁ-ん])(?=[{_HAN}ァ-ヺA-Za-z0-9])|(?<=[了吗呢吧嗎])(?=[{_HAN}])")
_TOKEN = re.compile(r"[^\s\"“”«»‹›„(（\[「『｢,;:，、：；،؛]+$")
_INNER = re.compile(r"[\"“”«»‹›„(（\[「『｢,;:，、：；،؛]")
_WORD = re.compile(r"[\w'’̀-ͯऀ-෿ั-๎-]+")
#: Runs of letters in a form that words have: lower case, capitalised, capitals, or without case.
_PIECE = re.compile(r"[^\W\d_]+")
#: Signs of dumps, addresses and code, which prose has few of: one a word at most half the time.
_CODE = re.compile(r"[\"'\]}][:,;=][\[\"'{\d]|[{}=|<>\\^~_#&*+/@$;]")
_MARKS = re.compile(r"[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯]{5}")


def units(text: str) -> list[tuple[int, int]]:
    """Spans of paragraphs and list items, without outer white space; empty ones are left out."""
    spans, at, end = [], 0, len(text)
    for m in [*_PARAGRAPH.finditer(text), None]:
        stop = m.start() if m else end
        for a, b in _items(text, at, stop):
            piece = text[a:b]
            a += len(piece) - len(piece.lstrip())
            b -= len(piece) - len(piece.rstrip())
            if a < b:
                spans.append((a, b))
        at = m.end() if m else stop
    return spans


def _value(number: str) -> int:
    return int(number) if number.isdecimal() else ord(number) - 96


def _items(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A paragraph cut before its list items.

    Bullets always begin an item. A number does so only where it starts the paragraph's list or goes on from the item
    before; other numbers at a line's start come from line breaks within prose.
    """
    lines = [a, *(m.end() for m in _LINE.finditer(text, a, b))]
    if len(lines) == 1:
        return [(a, b)]
    found = [_ITEM.match(text, i, b) for i in lines]
    if not any(found):
        return [(a, b)]
    seconds: dict[str, int] = {}
    for k, m in enumerate(found):
        if m and m.group(2) and _value(m.group(2)) == 2:
            seconds[m.group(3)] = k
    cuts, last = [], None
    for k, (i, m) in enumerate(zip(lines, found)):
        if not m:
            continue
        if m.group(1):
            cuts.append(i)
            continue
        value, style = _value(m.group(2)), m.group(3)
        if k == 0 or last == (value - 1, style) or (value == 1 and seconds.get(style, -1) > k):
            last = (value, style)
            if k:
                cuts.append(i)
    return list(zip([a, *cuts], [*cuts, b]))


class _Memo(dict):
    """A function's values by argument, forgotten when there are too many."""

    def __init__(self, f, most: int = 200_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, x):
        if len(self) >= self.most:
            self.clear()
        y = self[x] = self.f(x)
        return y


def _wordlike(token: str) -> int:
    """1 for a token that consists of words, -1 for one that does not, 0 for numbers and signs alone.

    In a token of words, most letters are in runs of the forms that words have (one case, or a capital first, not mixed
    with digits), and signs of dumps, addresses and code are few beside the runs.
    """
    if token.isalpha() and (token.islower() or token[1:].islower() or token.isupper()):
        return 1
    if _MARKS.search(token):
        return -1
    good = bad = runs = 0
    for m in _PIECE.finditer(token):
        w, i, j = m.group(), m.start(), m.end()
        runs += 1
        # A word is in one case, or has one change of case (Name, eBay, McKay, IDs) each way.
        changes = 0 if w.islower() or w.isupper() or w[1:].islower() else sum(x.islower() and y.isupper() for x, y in zip(w, w[1:])) + sum(x.isupper() and y.islower() for x, y in zip(w[1:], w[2:]))
        mixed = w[0] < "ɐ" and ((i and token[i - 1].isdigit()) or (j < len(token) and token[j].isdigit()))
        if changes <= 2 and not mixed:
            good += j - i
        else:
            bad += j - i
    if not runs:
        return 0 if any(map(str.isdigit, token)) or len(set(token)) < 3 else -1
    return 1 if good > bad and 2 * len(_CODE.findall(token)) <= runs else -1


_FORMS = _Memo(_wordlike)


def is_prose(piece: str) -> bool:
    """Whether a unit has words: at least as many of its tokens are words as are not; numbers alone count for neither."""
    return sum(map(_FORMS.__getitem__, piece.split())) >= 0


def _script(c: str) -> str:
    """Script of a letter by its name: cased, cjk, or its own."""
    if c < "ɐ":
        return "cased" if c.isalpha() else "sign"
    if c.isdigit():
        return "sign"
    if not c.isalpha() and not unicodedata.category(c).startswith("M"):
        return "sign"
    name = unicodedata.name(c, "NONE").split()[0].split("-")[0]
    if name in ("CJK", "HIRAGANA", "KATAKANA", "HALFWIDTH", "BOPOMOFO"):
        return "cjk"
    if name in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN"):
        return "cased"
    return {"ARABIC": "arabic", "DEVANAGARI": "deva", "THAI": "thai"}.get(name, name.lower())


_SCRIPTS = _Memo(_script)

_kinds: dict[str, set[str]] = {}
for _held in ABBREVIATIONS.values():
    for _kind, _all in _held.items():
        if not _kind.endswith("pair"):
            for _x in _all.split():
                _kinds.setdefault(_x.rstrip(".").lower(), set()).add(_kind)
#: Kinds of abbreviations by word; one that has several, in one language or more, has a kind of its own.
_KINDS = {_x: "+".join(sorted(_k)) for _x, _k in _kinds.items()}
#: Pairs of words that are one abbreviation: kind by its last word and the one before, and first words of such pairs.
_PAIRS: dict[tuple[str, str], str] = {}
_FIRSTS: set[str] = set()
for _held in ABBREVIATIONS.values():
    for _kind in ("pair", "tailpair"):
        for _x in filter(None, _held.get(_kind, "").split("|")):
            _words = [w.rstrip(".").lower() for w in _x.split()]
            for _p, _w in zip(_words, _words[1:]):
                _PAIRS[_p, _w] = "word-" if _kind == "pair" else "tail-"
                _FIRSTS.add(_p)
_STARTERS = {w for ws in STARTERS.values() for w in ws.split()}
_LOW_STARTERS = {w.lower() for w in _STARTERS}
_CALENDAR = {w.lower() for w in CALENDAR.split()}
_ORDINAL, _REPORTS = set(BEFORE_ORDINAL.split()), set(REPORTING.split())
_GOES_ON = {s: tuple(w) for s, w in GOES_ON.items()}
_VOWELS = set("aeiouyäöüàáâãèéêëìíîïòóôõùúûæœøåаеёиоуыэюяαεηιουωάέήίόύώ")


def _token_class(tok: str) -> str:
    """What stands before a stop: a kind of abbreviation, or a shape."""
    low = unicodedata.normalize("NFC", tok).lower()
    kind = _KINDS.get(low) or _KINDS.get(low.replace("’", "'").rsplit("'", 1)[-1])
    if kind:
        return f"{kind}{'' if tok[0].isupper() or tok.isupper() else '-'}"
    if low.replace(".", "").replace(",", "").replace("٫", "").isdigit():
        return "n2" if len(low) <= 2 else "num"
    if len(low) == 1:
        s = _SCRIPTS[tok]
        return ("I" if tok.isupper() else "i") if s == "cased" else f"one {s}" if tok.isalpha() else "sign"
    parts = low.split(".")
    if len(parts) > 1 and all(len(p) == 1 and p.isalpha() for p in parts if p):
        return "acronym" if tok.isupper() else "acronym-"
    if any(c.isdigit() for c in low) or "_" in low or "/" in low or "@" in low or "\\" in low:
        return "code"
    if len(parts) > 1 and any(parts[:-1]):
        return "dotted short" if len(parts[-1]) <= 3 and len(low) <= 8 else "dotted"
    s = _SCRIPTS[tok[-1]]
    if s != "cased":
        letters = sum(c.isalpha() for c in low)
        return f"{'short' if letters <= 2 else 'word'} {s}"
    word = low.rsplit("-", 1)[-1] or low
    case = "A" if tok.isupper() else "C" if tok[0].isupper() else ""
    if len(word) <= 5 and not _VOWELS.intersection(word):
        return f"vowelless{case}"
    return f"{'w3' if len(word) <= 3 else 'w4' if len(word) == 4 else 'w'}{case}"


_TOKENS = _Memo(_token_class)


def _word_class(word: str) -> str:
    """What follows a stop, of a word of a cased script."""
    if len(word) == 1:
        return ("A*" if word in _STARTERS else "A") if word.isupper() else "a"
    if any(map(str.isdigit, word)):
        return "code"
    low = word.lower()
    if low in _CALENDAR:
        return "calendar" if word[0].isupper() else "calendar-"
    if word[0].isupper():
        return "U*" if word in _STARTERS else "AA" if word.isupper() else "U"
    if any(map(str.isupper, word)):
        return "U"
    return "l*" if word in _LOW_STARTERS else "lk" if word in _KINDS else "l"


_WORDS = _Memo(_word_class)
_STOPS = frozenset(STOPS)
#: What a single stop is.
_STOP_KINDS = {c: "dots" if c == "…" else "stop" if c in FULL else "!?" if c in ASKING else "." for c in STOPS}
#: What may belong to a stop before it: closing marks, an apostrophe, further stops, and a blank before a closing «»».
_AFTER = CLOSERS | set(STOPS) | set("  \u202f\t\n\r\u2009")
_GAP = re.compile(r"\s+")
_QUOTES = set("“„«「『｢\"‹»")
_COMMAS, _DASHES = set(",;:，、：；،؛)]"), set("—–-")


def _follows(text: str, k: int, b: int, close_of: dict[int, int]) -> str:
    """Class of what follows at k."""
    if k >= b:
        return "end"
    c = text[k]
    if c.isalpha():
        s = _SCRIPTS[c]
        if s == "cased":
            w = _WORD.match(text, k, b).group()
            f = _WORDS[w]
            return f + "." if len(w) == 1 and text[k + 1 : k + 2] == "." else f
        on = _GOES_ON.get(s)
        return f"{s} on" if on and text.startswith(on, k) else s
    if c.isdigit():
        return "digit" if text[k + 1 : k + 2].isdigit() else "digit1"
    if c in BRACKETS:
        j = close_of.get(k, -1)
        return "aside" if j > 0 and text[j - 1] in STOPS else "bracket"
    if c in "¿¡":
        return "inverted"
    if c in _COMMAS:
        return "comma"
    if c in _DASHES:
        return "dash"
    return "quote" if c in _QUOTES else "other"


def _matching(marks: list, text: str) -> dict[int, int]:
    """Openers by place with the place of their closer; one that is never closed is left out."""
    close_of: dict[int, int] = {}
    waiting: list[tuple[str, int]] = []
    open_count: dict[str, int] = {}
    for m in marks:
        c = m.group()
        if c in CLOSERS:
            # The nearest opener that this closes; none is looked for if none waits.
            if any(open_count.get(o, 0) for o in _OPENED_BY.get(c, ())):
                while True:
                    o, at = waiting.pop()
                    open_count[o] -= 1
                    if c in OPENERS[o]:
                        close_of[at] = m.start()
                        break
                continue
        if c in OPENERS:
            waiting.append((c, m.start()))
            open_count[c] = open_count.get(c, 0) + 1
    return close_of


_OPENED_BY: dict[str, list[str]] = {}
for _o, _cs in OPENERS.items():
    for _c in _cs:
        _OPENED_BY.setdefault(_c, []).append(_o)


def _unmarked(text: str, a: int, b: int) -> list[tuple[int, tuple]]:
    """Places in a Chinese or Japanese unit without stops."""
    out = []
    for m in _UNMARKED.finditer(text, a, b):
        i, j = m.span()
        # Final particles of Chinese are one character, endings of Japanese two and more.
        short = text[i - 1 : i] if text[i - 1] > "ヿ" else text[max(a, i - 2) : i]
        out.append((i, ("cjk", "blank" if j > i else "none", text[max(a, i - 3) : i] if text[i - 1] <= "ヿ" else short, short, _SCRIPTS[text[j]], "kana" if "ぁ" <= text[j] <= "ヿ" else "")))
    return out


def candidates(text: str, a: int, b: int) -> list[tuple[int, tuple]]:
    """The places in a unit at which a sentence may end, each with what is known of it as a tuple."""
    head = _HEAD.match(text, a, b)
    start = head.end() if head else a
    piece = text[a:b]
    if not _STOP_RUN.search(piece):
        if _HAS_CJK.search(piece):
            return _unmarked(text, start, b)
        if not _HAS_RUN_ON.search(piece):
            return []
    low = piece.islower()
    run_on = _HAS_RUN_ON.search(piece)
    marks = list((_MARK_RUN_ON if run_on else _MARK).finditer(text, start, b))
    close_of = _matching(marks, text) if _PAIRED.search(piece) else {}
    opener_of = {j: i for i, j in close_of.items()}
    own_stop = bool(run_on) and any(x in piece for x in "။។៕")
    out: list[tuple[int, tuple]] = []
    stack: list[tuple[str, str, int]] = []
    done, stops, scripts, kinds = start, _STOPS, _SCRIPTS, _STOP_KINDS
    for m in marks:
        i = m.start()
        if i < done:
            continue
        c = text[i]
        if c not in stops:
            if i in close_of:
                k = i - 1
                while k >= start and text[k].isspace():
                    k -= 1
                p = text[k] if k >= start else ""
                begins = not p or p in stops or (out and out[-1][0] == k + 1) or (p in CLOSERS and k > start and text[k - 1] in stops)
                stack.append((c, "start" if begins else "colon" if p in ":：" else "comma" if p in ",，、،" else "mid", i))
            elif i in opener_of:
                while stack and stack.pop()[2] != opener_of[i]:
                    pass
            elif c.isspace():
                out.append((i, ("gap", scripts[text[i - 1]], "in" if stack else "", own_stop)))
            continue
        j = i + 1
        x = text[j] if j < b else " "
        if c == "." and x.isdigit() and i > start and (text[i - 1].isdigit() or text[i - 1] == " "):
            continue  # within a number
        while x in stops:
            j += 1
            x = text[j] if j < b else " "
        k, closed = j, None
        while k < b and x in _AFTER:
            q = k
            if x.isspace() and k + 1 < b and text[k + 1] == "»" and k + 1 in opener_of:
                q += 1
            if q in opener_of:
                o = opener_of[q]
                while stack:
                    closed = stack.pop()
                    if closed[2] == o:
                        break
                k = q + 1
            elif closed and x in stops:
                k += 1
            elif x in "’'" and not (k + 1 < b and text[k + 1].isalpha()):
                k += 1
            else:
                break
            x = text[k] if k < b else " "
        done = g = k
        if k < b and x.isspace():
            g = k + 1
            while g < b and text[g].isspace():
                g += 1
        gap = "none" if g == k else "blank"
        if j == i + 1:
            kind = kinds[c]
        else:
            run = text[i:j]
            kind = "dots" if run[0] == "…" or run.strip(".") == "" else kinds[run[-1]].replace("dots", ".")
        follows = _follows(text, g, b, close_of)
        if follows == "l*" and not low:
            follows = "l"
        # The token before the stop; a long one is no abbreviation, whatever it begins with.
        left = text[max(start, i - 24) : i]
        words = left.split()
        tok = words[-1] if words and not left[-1].isspace() else ""
        if _INNER.search(tok):
            tok = _TOKEN.search(tok)
            tok = tok.group() if tok else ""
        at = len(left) - len(tok)
        tc = _TOKENS[tok] if tok else "closed" if left and left[-1] in CLOSERS else "none"
        script, before = scripts[left[-1]] if left else "none", ""
        if kind == "dots" and script == "cjk" and "ぁ" <= left[-1] <= "ん":
            tc = f"kana {left[-1]}"
        if kind == "." and tok and len(tok) <= 8:
            p = words[-1][: -len(tok)] or (words[-2] if len(words) > 1 else "")
            bare = p.strip("([\"“„«").rstrip(".").lower()
            two = _PAIRS.get((bare, tok.lower()))
            if two:
                tc = two
            elif tc in ("n2", "num"):
                before = "ordinal" if bare in _ORDINAL else "abbr" if _KINDS.get(bare) else "low" if p.islower() else "cap" if p else "first"
            elif tc in ("I", "i", "acronym"):
                first = tok.lower() in _FIRSTS and follows.endswith(".")
                before = "pair" if first else "name" if p and (p[0].isupper() or p.endswith(".")) and p.rstrip(".") not in _STARTERS else "first" if not p else ""
            elif at == 0 or (out and out[-1][0] - max(start, i - 24) >= at - 1):
                before = "first"
        within = (("bracket" if stack[-1][0] in BRACKETS else "quote"), stack[-1][1]) if stack else None
        if closed:
            shape = "bracket" if closed[0] in BRACKETS else "quote"
            said = ""
            if shape == "quote" and follows not in ("end", "digit", "digit1"):
                nxt = text[g : g + 40].split(None, 3)[:3]
                said = "said" if any(w.strip(",;:.—–-") in _REPORTS for w in nxt) else ""
            closed = (shape, closed[1], said)
        out.append((k, (kind, tc, follows, gap, low, script, before, closed, within)))
    return out


def features(key: tuple) -> list[str]:
    """The features of a place, as texts."""
    if key[0] == "gap":
        _, script, within, own = key
        return ["gap", f"gap {script} {own}", f"gap {within} {own}", f"gap {script} {within} {own}"]
    if key[0] == "cjk":
        _, gap, three, two, after, kana = key
        return [f"cjk {gap}", f"cjk {gap} {two}", f"cjk {two}", f"cjk {three}", f"cjk {two} {after} {kana}", f"cjk {gap} {after} {kana}"]
    kind, tc, follows, gap, low, script, before, closed, within = key
    case = "low" if low else ""
    broad = "upper" if follows[0] in "UA" or follows == "calendar" else "lower" if follows[0] in "la" and follows[:2] not in ("as", "ar") else follows.rstrip("1")
    f = [kind, f"{kind}|{broad}|{gap}", f"{kind}|{tc}|{broad}", f"{kind}|{broad}", f"{kind}|{follows}", f"{kind}|{follows}|{gap}", f"{kind}|{follows}|{case}", f"{kind}|{script}", f"{kind}|{script}|{follows}"]
    if within:
        f += ["in", f"in {within[0]}", f"in {within[1]}|{kind}", f"in {within[0]} {within[1]}"]
    if closed:
        shape, where, said = closed
        f += [f"{shape}|{where}", f"{shape}|{where}|{follows}", f"{shape}|{where}|{follows}|{case}", f"{shape}|{where}|{script}", f"{shape}|{where}|{kind}", f"{shape}|{where}|{said}", f"{shape}|{said}|{follows}"]
    elif kind in (".", "dots"):
        f += [f"{kind}|{tc}", f"{kind}|{tc}|{follows}", f"{kind}|{tc}|{follows}|{gap}{case}", f"{kind}|{tc}|{case}", f"{kind}|{tc}|{gap}|{script}"]
        if before:
            f += [f"{before}|{tc}", f"{before}|{tc}|{follows}", f"{before}|{follows}"]
    return f


class Tagger:
    """Weights of the chain: of features for the tag boundary, and of pairs of tags by how near two places are."""

    def __init__(self, weights: dict[str, float], pairs: dict[tuple[int, int, bool], float]):
        self.weights, self.pairs = weights, pairs
        self.scores = _Memo(lambda key: sum(weights.get(x, 0.0) for x in features(key)))
        self.moves = {near: [[pairs.get((s, t, near), 0.0) for s in (0, 1)] for t in (0, 1)] for near in (False, True)}

    def decode(self, places: list[tuple[int, tuple]]) -> list[int]:
        """Viterbi: the best tags (1 boundary, 0 inside) of the places."""
        scores, moves = self.scores, self.moves
        b0 = b1 = 0.0
        back, last = [], None
        for at, key in places:
            score = scores[key]
            if last is None:
                b1 = score
                back.append((0, 0))
            else:
                (m00, m10), (m01, m11) = moves[at - last < 6]
                x0, y0, x1, y1 = b0 + m00, b1 + m10, b0 + m01, b1 + m11
                back.append((y0 > x0, y1 > x1))
                b0, b1 = (y0 if y0 > x0 else x0), (y1 if y1 > x1 else x1) + score
            last = at
        tag, out = int(b1 > b0), []
        for row in reversed(back):
            out.append(tag)
            tag = int(row[tag])
        return out[::-1]


def train(examples: list[tuple[str, list[int]]], epochs: int = EPOCHS) -> Tagger:
    """The averaged structured perceptron over composed paragraphs with known ends."""
    data = []
    for text, ends in examples:
        known = set(ends)
        # A place before a blank stands where the sentence ends.
        places = [p for p in candidates(text, 0, len(text)) if p[0] < len(text)]
        data.append((places, [int(at in known) for at, _ in places]))
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    pairs: dict[tuple[int, int, bool], float] = {}
    pair_total: dict[tuple[int, int, bool], float] = {}
    named = _Memo(features)
    step = 1
    for _ in range(epochs):
        for places, gold in data:
            tagger = Tagger.__new__(Tagger)
            tagger.scores = {key: sum([w.get(x, 0.0) for x in named[key]]) for _, key in places}
            tagger.moves = {near: [[pairs.get((s, t, near), 0.0) for s in (0, 1)] for t in (0, 1)] for near in (False, True)}
            guess = tagger.decode(places)
            if guess != gold:
                last = None
                for n, ((at, key), g, y) in enumerate(zip(places, guess, gold)):
                    if g != y:
                        d = 1.0 if y else -1.0
                        for x in named[key]:
                            w[x] = w.get(x, 0.0) + d
                            total[x] = total.get(x, 0.0) + d * step
                    if n and (g, guess[n - 1]) != (y, gold[n - 1]):
                        near = at - last < 6
                        for move, d in (((gold[n - 1], y, near), 1.0), ((guess[n - 1], g, near), -1.0)):
                            pairs[move] = pairs.get(move, 0.0) + d
                            pair_total[move] = pair_total.get(move, 0.0) + d * step
                    last = at
            step += 1
    return Tagger({x: v - total[x] / step for x, v in w.items()}, {x: v - pair_total[x] / step for x, v in pairs.items()})


@lru_cache(maxsize=2)
def trained(n: int = TRAINING_PARAGRAPHS) -> Tagger:
    return train(paragraphs(n))


def spans(text: str, tagger: Tagger) -> list[tuple[int, int]]:
    """The sentences of a text as offsets in code points, end exclusive, without outer white space."""
    out = []
    for a, b in units(text):
        places = candidates(text, a, b)
        if places and places[-1][0] >= b:
            places.pop()
        tags = tagger.decode(places) if places else ()
        if 1 in tags and is_prose(text[a:b]):
            for (at, _), tag in zip(places, tags):
                if tag:
                    while a < at and text[a].isspace():
                        a += 1
                    e = at
                    while e > a and text[e - 1].isspace():
                        e -= 1
                    if a < e:
                        out.append((a, e))
                    a = at
        while a < b and text[a].isspace():
            a += 1
        if a < b:
            out.append((a, b))
    return out


def split_sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, start_at long, end_at long): one row per sentence of every document.

    Null, empty and blank texts have no rows; the sentences of a text cover all its other characters. Texts are taken
    whole. Rows that repeat a doc_id give their own rows. Other columns are never read. The model is trained once on the
    driver, from a fixed number of composed paragraphs, and sent to the executors.
    """
    model = trained()
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*held.value)
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in spans(x, tagger) if x else ():
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_at", "end_at"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, start_at long, end_at long")
