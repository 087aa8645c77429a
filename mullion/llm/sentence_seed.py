"""Training paragraphs for the sentence tagger, composed by rule with known ends.

Words are random letters of a script, so that nothing is learnt of any subject; sentences are built from constructions:
plain ones, abbreviations by kind, initials, numbers, dates and names of files, quotations with and without reporting
words, brackets, and interrupted sentences. Only the fixed lists of sentence_lexicon are real words. Scripts that are
written without stops are trained on sentences whose stops are stripped.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from mullion.llm.sentence_lexicon import ABBREVIATIONS, BEFORE_ORDINAL, CALENDAR, ENDINGS, GOES_ON, PARTICLES, REPORTING, STARTERS

#: Letters from which words are made: two strings are consonants and vowels in turn, a pair of numbers is a range.
LETTERS = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou"),
    "cyrillic": ("бвгджзклмнпрстфхцчш", "аеиоуыя"),
    "greek": ("βγδζθκλμνπρστφχ", "αεηιοω"),
    "armenian": ("բգդզկլմնպրստ", "աեիոե"),
    "arabic": ("بتثجحخدرزسشصضطعغفقكلمنه", "اوي"),
    "hebrew": ("בגדזחטכלמנסעפצקרשת", "אויה"),
    "deva": ("कखगचजटडतदनपबमरलवसह", "ािीुेो"),
    "bengali": ("কখগচজটডতদনপবমরলসহ", "ািীুেো"),
    "georgian": ("ბგდვზთკლმნპრსტ", "აეიოუ"),
    "ethiopic": (0x1208, 0x1350),
    "hangul": (0xAC00, 0xD7A4),
    "thai": ("กขคงจชดตทนบปผพมยรลวสหอ", "ะาิีุู"),
    "lao": ("ກຂຄງຈຊດຕທນບປຜພມຢຣລວສຫອ", "ະາິີຸູ"),
    "khmer": ("កខគងចឆជតថទនបផពមយរលវសហ", "ាិីុូេ"),
    "burmese": ("ကခဂငစဆညတထဒနပဖဗမယရလဝသဟ", "ာိီုူေ"),
    "han": (0x4E00, 0x9FA5),
    "kana": (0x3042, 0x3090),
    "kata": (0x30A2, 0x30F0),
}
#: Script, weight, full stops, question marks and quotation marks by language.
LANGUAGES = {
    "en": ("latin", 9, ".", "?", "“”\"\""),
    "de": ("latin", 4, ".", "?", "„“»«"),
    "fr": ("latin", 4, ".", "?", "«»“”"),
    "es": ("latin", 4, ".", "?", "«»“”"),
    "it": ("latin", 1, ".", "?", "«»“”"),
    "pt": ("latin", 1, ".", "?", "“”«»"),
    "nl": ("latin", 1, ".", "?", "“”\"\""),
    "pl": ("latin", 1, ".", "?", "„”«»"),
    "ru": ("cyrillic", 4, ".", "?", "«»„“"),
    "el": ("greek", 1, ".", "!", "«»“”"),
    "hy": ("armenian", 1, "։", "։", "«»"),
    "zh": ("han", 3, "。", "？", "“”「」"),
    "ja": ("kana", 3, "。", "？", "「」『』"),
    "ko": ("hangul", 1, ".", "?", "“”\"\""),
    "hi": ("deva", 3, "।", "?", "“”\"\""),
    "bn": ("bengali", 1, "।", "?", "“”"),
    "ar": ("arabic", 3, ".", "؟", "«»“”"),
    "ur": ("arabic", 1, "۔", "؟", "“”"),
    "he": ("hebrew", 1, ".", "?", "“”\"\""),
    "ka": ("georgian", 1, ".", "?", "„“"),
    "am": ("ethiopic", 1, "።", "፧", "«»"),
    "th": ("thai", 3, "", "", "“”"),
    "lo": ("lao", 1, "", "", "“”"),
    "km": ("khmer", 1, "។", "?", "«»"),
    "my": ("burmese", 1, "။", "။", "“”"),
}
CASED = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru", "el", "hy")
JOINED = ("zh", "ja")
#: Scripts that put a blank between sentences or phrases only.
RUN_ON = ("th", "lo", "km", "my")


def _word(lang: str, r: random.Random, least: int = 1, most: int = 4) -> str:
    script = LANGUAGES[lang][0]
    if lang == "ja":
        script = r.choice(("kana", "han", "han", "kata"))
    letters = LETTERS[script]
    n = r.randint(least, most)
    if isinstance(letters[0], int):
        return "".join(chr(r.randrange(*letters)) for _ in range(n))
    a, b = letters
    w = "".join(r.choice(a) + r.choice(b) + (r.choice(a) if r.random() < 0.35 else "") for _ in range(n))
    return w + r.choice(a) if r.random() < 0.4 else w


def _name(lang: str, r: random.Random) -> str:
    """A name; now and then in Latin letters, where the script has no letter case."""
    return _word(lang if lang in CASED or r.random() < 0.6 else "en", r, 2, 3).capitalize()


def _space(lang: str) -> str:
    return "" if lang in JOINED + RUN_ON else " "


def _words(lang: str, r: random.Random, least: int = 1, most: int = 5) -> str:
    """Words, now and then function words in lower case among them."""
    small = STARTERS.get(lang, "").lower().split()
    gap = " " if lang in ("km", "my") and r.random() < 0.3 else _space(lang)
    return gap.join(r.choice(small) if small and r.random() < 0.2 else _word(lang, r) for _ in range(r.randint(least, most)))


def _begin(lang: str, r: random.Random) -> str:
    """The first word of a sentence: a function word, any word, or now and then a number or an odd name."""
    if lang not in CASED:
        return _word(lang, r)
    x = r.random()
    if x < 0.5 and lang in STARTERS:
        return r.choice(STARTERS[lang].split())
    if x < 0.92:
        return _word(lang, r).capitalize()
    if x < 0.96:
        return str(r.randint(2, 99))
    return r.choice((_word(lang, r).upper(), r.choice("bfikmpx") + _word(lang, r).capitalize()))


def _abbreviation(lang: str, kind: str, r: random.Random) -> str:
    held = ABBREVIATIONS.get(lang, {})
    pairs = held.get("pair" if kind == "word" else "tailpair" if kind == "tail" else "", "")
    if pairs and r.random() < 0.4:
        return r.choice(pairs.split("|"))
    return r.choice(held[kind].split())


def _decimal(lang: str, r: random.Random) -> str:
    return f"{r.randint(0, 99)}{'.' if lang in ('en', 'zh', 'ja', 'th', 'hi') else r.choice(',.')}{r.randint(0, 99)}"


def _file(r: random.Random) -> str:
    return f"{_word('en', r)}{r.choice(('_', '-', ''))}{r.randint(1, 99)}.{r.choice(('txt', 'csv', 'wav', 'PDF', 'TXT', 'tar.gz', f'v{r.randint(1, 9)}.csv', f'{r.randint(1, 12)}.log'))}"


def _link(r: random.Random) -> str:
    return r.choice((f"https://{_word('en', r)}.org/{_word('en', r)}?{_word('en', r)}={r.randint(1, 99)}", f"www.{_word('en', r)}.com", f"{_word('en', r)}@{_word('en', r)}.net"))


def _last(lang: str, r: random.Random) -> str:
    """The last words before a stop."""
    n = r.randint(1, 99)
    w = _word(lang, r)
    ends: list[Callable[[], str]] = [lambda: w, lambda: w, lambda: w, lambda: w, lambda: f"{w}{_space(lang)}{n}", lambda: f"{w}{_space(lang)}{_decimal(lang, r)}", lambda: f"{w} {n} %"]
    if lang in CASED:
        ends += [
            lambda: w[:3], lambda: _name(lang, r), lambda: f"{w}-{w[::-1]}", lambda: w.upper(), lambda: f"{w} {r.randint(1900, 2030)}", lambda: f"{w} {n} {r.choice(('m', 'km', 'kg', 's', 'V'))}",
            lambda: f"{w} v{r.randint(1, 9)}.{n}", lambda: f"{_name(lang, r)}-{r.choice('ABK')}{n}", lambda: f"{w} {r.choice('ABCDX')}", lambda: _file(r), lambda: f"({w} {n})", lambda: f"{w} ({_name(lang, r)})",
        ]
    return r.choice(ends)()


def _stop(lang: str, r: random.Random) -> str:
    _, _, full, ask, _ = LANGUAGES[lang]
    x = r.random()
    if x < 0.78 or not full:
        return full
    if x < 0.88:
        return ask
    return r.choice(("!", "!", "?!", "!!")) if lang not in JOINED else r.choice(("！", "！", "？！", "!"))


def _plain(lang: str, r: random.Random) -> str:
    gap = _space(lang)
    comma = {"zh": "，", "ja": "、", "ar": "، ", "ur": "، "}.get(lang, ", ")
    middle = _words(lang, r)
    if r.random() < 0.25:
        middle += f"{comma if lang not in RUN_ON else ''}{_words(lang, r, 1, 3)}"
    if r.random() < 0.06:
        middle += f"{r.choice(('; ', ': '))}{_word(lang, r)}" if lang not in RUN_ON + JOINED else ""
    if r.random() < 0.12:
        thing = r.choice((_decimal(lang, r), _file(r), _link(r) if lang in CASED else _file(r), f"{r.randint(1, 12)}:{r.randint(10, 59)}", f".{r.randint(10, 99)}" if lang in CASED else str(r.randint(1, 99))))
        middle += f" {thing} {_word(lang, r)}" if lang not in JOINED else f"{thing}{_word(lang, r)}"
    if lang == "ja":
        return f"{_begin(lang, r)}{middle}{r.choice(ENDINGS['ja']) if r.random() < 0.8 else _word(lang, r)}{_stop(lang, r)}"
    if lang == "zh":
        return f"{_begin(lang, r)}{middle}{r.choice(ENDINGS['zh']) if r.random() < 0.3 else _word(lang, r)}{_stop(lang, r)}"
    s = f"{_begin(lang, r)}{gap}{middle}{gap}{_last(lang, r)}"
    if r.random() < 0.05 and lang in CASED:
        s = s.upper()
    return s + _stop(lang, r)


def _short_form(lang: str, r: random.Random) -> str:
    """A sentence with an abbreviation in it or at its end."""
    kinds = [k for k in ABBREVIATIONS.get(lang, {}) if not k.endswith("pair")]
    if not kinds or r.random() < 0.12 and lang in CASED:
        return _initials(lang, r)
    kind = r.choice(kinds)
    x = _abbreviation(lang, kind, r)
    head, n, w, full = f"{_begin(lang, r)} {_words(lang, r, 1, 3)}", r.randint(1, 99), _word(lang, r), LANGUAGES[lang][2]
    first = r.random() < 0.15
    if kind == "title":
        return f"{x} {_name(lang, r)} {_words(lang, r)}{full}" if first else f"{head} {x} {_name(lang, r)} {w}{full}"
    if kind == "ref":
        number = r.choice((str(n), str(n), str(n), _decimal(lang, r), f"{r.choice('ABC')}{n}", f"{n}–{n + 3}", "~" + str(n)))
        if first:
            return f"{x[0].upper()}{x[1:]} {number} {_words(lang, r)}{full}"
        return f"{head} {x} {number}{r.choice((f' {w}', f' {w}', '', f', {w}'))}{full}"
    if kind == "word":
        after = r.choice((w, w, _name(lang, r), str(n), _word(lang, r)))
        return f"{head} {x} {after} {w}{full}" if r.random() < 0.8 else f"{head} ({x} {after}) {w}{full}"
    if kind == "unit":
        number = r.choice((str(n), str(r.randint(1800, 2030)), _decimal(lang, r), f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}"))
        return f"{head} {number} {x} {_words(lang, r, 1, 3)}{full}" if r.random() < 0.6 else f"{head} {number} {x}{'' if full == '.' else ' ' + full}"
    if kind == "month":
        return f"{head} {x} {n} {w}{full}" if r.random() < 0.8 else f"{head} {n} {x} {r.randint(1900, 2030)} {w}{full}"
    if kind == "hour":
        y = r.random()
        if y < 0.45:
            return f"{head} {r.randint(1, 12)} {x}"
        return f"{head} {r.randint(1, 12)} {x} {r.choice((w, w, r.choice(CALENDAR.split()), 'and ' + w))} {w}."
    if kind == "taxon":
        y = r.random()
        name = _name(lang, r)
        if y < 0.3:
            return f"{head} {name} {x}"
        after = r.choice((r.choice("ABCDEFGH"), r.choice("ABCDEFGH"), w, str(r.randint(1, 9)), "nov."))
        return f"{r.choice((head + ' ', ''))}{name} {x} {after} {_words(lang, r, 1, 3)}."
    # A list's or a name's last word: it ends the sentence as often as not.
    name = f" {_name(lang, r)}" if x[0].isupper() or r.random() < 0.4 else f", {w}, "
    y = r.random()
    if y < 0.5:
        return f"{head}{name.rstrip(' ') if r.random() < 0.5 else name} {x}".replace(",  ", ", ")
    return f"{head}{name} {x}{r.choice((f' {w}', f', {w}', f' ({r.randint(1900, 2030)}) {w}', f' {w} {w}'))}{full}".replace("  ", " ")


def _initials(lang: str, r: random.Random) -> str:
    """Initials of a person, an acronym with stops, or a lone letter at the end."""
    cap = lambda: _word(lang, r)[0].upper()
    head, w, y = f"{_begin(lang, r)} {_words(lang, r, 1, 3)}", _word(lang, r), r.random()
    if y < 0.35:
        letters = " ".join(f"{cap()}." for _ in range(r.randint(1, 3)))
        first = f"{_name(lang, r)} " if r.random() < 0.5 else ""
        return f"{first}{letters} {_name(lang, r)} {_words(lang, r)}." if r.random() < 0.5 else f"{head} {first}{letters} {_name(lang, r)} {w}."
    acronym = "".join(f"{cap()}." for _ in range(r.randint(2, 3)))
    if y < 0.8:
        return f"{head} {acronym} {w} {w}." if r.random() < 0.6 else f"{_begin(lang, r)} {acronym} {_name(lang, r)} {w}."
    return f"{head} {acronym}" if r.random() < 0.4 else f"{head} {w} {r.choice('ABCDX')}."


def _ordinal(r: random.Random) -> str:
    """German numbers with a stop: days and ordinals, which go on, and plain ends."""
    n, w, y = r.randint(1, 31), _word("de", r), r.random()
    what = r.choice((r.choice(CALENDAR.split()), w, w.capitalize(), w.capitalize(), f"{r.randint(1, 12)}. {r.randint(1900, 2030)}"))
    before = r.choice(BEFORE_ORDINAL.split())
    if y < 0.4:
        return f"{before.capitalize()} {n}. {what} {_words('de', r)}."
    if y < 0.8:
        return f"{_begin('de', r)} {_words('de', r, 1, 3)} {before} {n}. {what}{r.choice(('', f' {w}'))}."
    return f"{before.capitalize()} {n}.{r.randint(1, 12)}.{r.randint(1990, 2030)} {_words('de', r)} {n}.{r.randint(10, 59)} {w}."


def _quotation(lang: str, r: random.Random) -> str:
    """Words of a speaker with the reporting words before, after or on both sides, or words in quotation marks."""
    marks, gap = LANGUAGES[lang][4], _space(lang)
    k = 2 * r.randrange(len(marks) // 2)
    a, b = marks[k], marks[k + 1]
    if lang == "fr" and a == "«":
        a, b = "« ", " »"
    inside = f"{_begin(lang, r)}{gap}{_words(lang, r)}"
    stop = LANGUAGES[lang][2] or r.choice(("?", "!", ""))
    loud = r.choice([x for x in (LANGUAGES[lang][3], "!", "?") if x and x != stop]) if lang not in JOINED else r.choice("？！")
    said = f"{_word(lang, r)}{gap}{r.choice(REPORTING.split()) if lang in CASED else _word(lang, r)}"
    if lang in CASED and r.random() < 0.3:
        said = f"{r.choice(REPORTING.split())} {_name(lang, r)}" if r.random() < 0.5 else f"{_name(lang, r)} {r.choice(REPORTING.split())}"
    more, y = _words(lang, r, 1, 3), r.random()
    colon = {"zh": "：", "ja": "：", "fr": " : "}.get(lang, ": ") if lang not in RUN_ON else ""
    comma = {"zh": "，", "ja": "、", "ar": "، "}.get(lang, ", ")
    begin = _begin(lang, r)
    if y < 0.3:
        return f"{begin}{gap}{said}{colon}{a}{inside}{r.choice((stop, stop, loud))}{b}" + (LANGUAGES[lang][2] if r.random() < 0.15 else "")
    if y < 0.65:
        dash = r.choice((" — ", ", ", " ")) if lang in CASED else gap if lang not in ("ar", "hi", "bn", "ur", "ko", "he", "am", "ka") else " "
        return f"{a}{inside}{r.choice((loud, loud, '…' if lang not in JOINED else '……'))}{b}{dash}{said}{gap}{more}{LANGUAGES[lang][2]}"
    if y < 0.75 and lang in CASED:
        return f"{a}{inside}{r.choice((',', ''))}{b}, {said}, {a}{more}{stop}{b}"
    if y < 0.9:
        return f"{begin}{gap}{more}{' ' if gap else ''}{a}{_word(lang, r)}{r.choice(('', '', loud, stop))}{b}{' ' if gap else ''}{_words(lang, r)}{LANGUAGES[lang][2]}"
    return f"{begin}{gap}{said}{comma if gap else ''}{a}{inside}{stop}{b}{' ' if gap else ''}{more}{LANGUAGES[lang][2]}"


def _bracket(lang: str, r: random.Random) -> str:
    """A sentence in brackets, or one with a bracket in it that may hold stops of its own."""
    a, b = r.choice(("（）", "（）", "()")) if lang in JOINED else r.choice(("()", "()", "()", "[]"))
    full, gap = LANGUAGES[lang][2] or "!", _space(lang)
    y = r.random()
    if y < 0.4:
        return f"{a}{_begin(lang, r)}{gap}{_words(lang, r)}{gap}{_last(lang, r)}{full}{b}"
    held = r.choice((_words(lang, r, 1, 3), f"{_word(lang, r)} {r.randint(1, 99)}", f"{_word(lang, r)}{full}", f"{_words(lang, r, 1, 3)}{gap}{r.randint(1, 99)}!", f"{_word(lang, r)[:3]}. {r.randint(1, 9)}"))
    if y < 0.75:
        return f"{_begin(lang, r)}{gap}{_words(lang, r)}{' ' if gap else ''}{a}{held}{b}{' ' if gap else ''}{_words(lang, r)}{LANGUAGES[lang][2]}"
    return f"{_begin(lang, r)}{gap}{_words(lang, r)}{' ' if gap else ''}{a}{held}{b}{LANGUAGES[lang][2]}"


def _broken(lang: str, r: random.Random) -> str:
    """An interrupted sentence that goes on, or one that ends with an ellipsis."""
    dots = "……" if lang == "zh" else "…" if lang in ("ja", "ru") and r.random() < 0.6 else r.choice(("...", "…", "..."))
    gap, head = _space(lang), f"{_begin(lang, r)}{_space(lang)}{_words(lang, r)}"
    if lang in RUN_ON:
        return f"{head}{_words(lang, r)}"
    if r.random() < 0.45:
        return f"{head}{gap}{_last(lang, r)}{dots}" if lang != "ja" else f"{head}{r.choice((*ENDINGS['ja'], _word('zh', r)))}{dots}"
    on = GOES_ON.get({"zh": "cjk", "ja": "cjk", "ar": "arabic", "ur": "arabic", "hi": "deva"}.get(lang, ""))
    link = r.choice(on) if on else _words(lang, r, 1, 1)
    if lang in CASED and r.random() < 0.3:
        head += gap + _last(lang, r)
    if lang in JOINED:
        link = r.choice([x for x in on if (x[0] > "ヿ") == (lang == "zh")])
    if lang == "ja" and r.random() < 0.7:
        head, link = head + r.choice(PARTICLES), _word(lang, r)
    return f"{head}{r.choice((' ', '')) if gap else ''}{dots}{' ' if gap else ''}{link}{gap}{_words(lang, r)}{LANGUAGES[lang][2]}"


def sentence(lang: str, r: random.Random) -> str:
    x = r.random()
    if lang in CASED:
        if x < 0.17:
            return _ordinal(r) if lang == "de" and r.random() < 0.45 else _short_form(lang, r)
        if x < 0.27:
            return _quotation(lang, r)
        if x < 0.35:
            return _bracket(lang, r)
        return _broken(lang, r) if x < 0.40 else _plain(lang, r)
    if x < 0.15:
        return _quotation(lang, r)
    if x < 0.22 and lang not in RUN_ON:
        return _bracket(lang, r)
    if x < 0.30:
        return _broken(lang, r)
    return _short_form(lang, r) if x < 0.36 and lang in ABBREVIATIONS else _plain(lang, r)


def _inverted(s: str) -> str:
    """Spanish questions and cries open with their mark."""
    return ("¿" if s.endswith("?") else "¡") + s if s.endswith(("?", "!")) and s[0].isalpha() else s


def paragraph(r: random.Random) -> tuple[str, list[int]]:
    """A paragraph and the offsets where its sentences end."""
    lang = r.choices(list(LANGUAGES), weights=[v[1] for v in LANGUAGES.values()])[0]
    lower, loose = lang in CASED and r.random() < 0.12, r.random() < 0.12
    stripped = lang in RUN_ON[:2] or (lang in JOINED and r.random() < 0.3) or (lang in RUN_ON and r.random() < 0.5)
    text, ends = "", []
    for _ in range(r.randint(2, 6)):
        other = r.random() < 0.04 and lang not in RUN_ON and not stripped
        spoken = r.choice(("en", "en", "de", "fr", "es", "ru")) if other else lang
        s = _plain(spoken, r) if stripped and lang in JOINED else sentence(spoken, r)
        if spoken == "es" and r.random() < 0.8:
            s = _inverted(s)
        if lower:
            s = s.lower()
        if stripped:
            s = s.rstrip("".join({v[2] + v[3] for v in LANGUAGES.values()}) + "!！")
        if not s or not s[0].isprintable():
            continue
        if text:
            gap = r.choices([" ", "  ", "\n", "\t", "      "], weights=[82, 6, 7, 2, 3])[0]
            if lang in JOINED:
                gap = "" if r.random() < 0.9 else gap
            elif lang not in RUN_ON and loose and s[0].isalpha() and not lower and text[-1] in "!?" + LANGUAGES[spoken][2] and text[-3:-2] != "." and not text.endswith(("sp.", "etc.", "..")):
                gap = ""
            text += gap
        if r.random() < 0.1 and " " in s and lang not in RUN_ON:
            # A hard line break inside a sentence.
            i = r.choice([i for i, c in enumerate(s) if c == " "])
            s = s[:i] + "\n" + s[i + 1 :]
        text += s
        ends.append(len(text))
    return text, ends


def paragraphs(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    r = random.Random(seed)
    return [paragraph(r) for _ in range(n)]
