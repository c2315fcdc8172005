"""The anatomy of a raw model answer: its string values, whether its structure closes, what it says, and in which language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .text import words

_DOUBLE = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}\[\]]', re.S)
_SINGLE = re.compile(r"""(?<=[\[{,:\s])'(?:[^'\\]|\\.|'(?!\s*[,:\]}]))*'(?=\s*[,:\]}])|(?<=[\[{,:\s])'|"(?:[^"\\]|\\.)*"|[{}\[\]]""", re.S)
_COLON = re.compile(r"\s*:")
_FENCE = re.compile(r"^\s*(```|~~~)\w*[ \t]*\n?|\n?(```|~~~)\s*$")
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\.", re.S)
_ITEM = re.compile(r"\s*([-*•–]|\d+[.)])\s")
_SPACES = re.compile(r"\s+")
_SIMPLE = {"\\n": "\n", "\\t": "\t", "\\r": "\r", '\\"': '"', "\\/": "/", "\\\\": "\\", "\\'": "'"}


@dataclass
class Answer:
    """values: (key, text) of every string value. closed: None without structure, else whether it ends. before, after: prose around it."""

    text: str
    values: list[tuple[str, str]] = field(default_factory=list)
    closed: bool | None = None
    before: str = ""
    after: str = ""
    open_value: bool = False


def _plain(literal: str) -> str:
    if "\\" not in literal:
        return literal

    def one(m):
        e = m.group()
        return chr(int(e[2:], 16)) if e[1] == "u" and len(e) == 6 else _SIMPLE.get(e, e[1:])

    return _ESCAPE.sub(one, literal)


def dissect(text: str) -> Answer:
    """An answer's anatomy; structure is read leniently: other quotes, bare keys, stray commas and prose around it are fine."""
    root = text.find("{")
    if root < 0:
        return Answer(text, before=text)
    found = Answer(text, before=text[:root], closed=False)
    token = _SINGLE if re.match(r"\{\s*'", text[root:]) else _DOUBLE
    depth, key = 0, ""
    for m in token.finditer(text, root):
        t = m.group()
        if t in "{[":
            depth += 1
        elif t in "}]":
            depth -= 1
            if depth <= 0:
                found.closed, found.after = True, text[m.end() :]
                return found
        elif len(t) == 1:
            found.values.append((key, _plain(text[m.end() :])))
            found.open_value = True
            break
        elif _COLON.match(text, m.end()):
            key = t[1:-1]
        else:
            found.values.append((key, _plain(t[1:-1])))
    tail = _FENCE.sub("", text).rstrip()
    if tail.endswith("}") and all(tail.count(a) <= tail.count(b) for a, b in ("{}", "[]")):
        found.closed = True
    return found


def said(a: Answer) -> list[str]:
    """What the answer says, piece by piece: prose without fences, and string values."""
    prose = [_FENCE.sub("", x) for x in (a.before, a.after)] if a.closed is not None else [_FENCE.sub("", a.text)]
    return [p for p in (*prose, *(v for _, v in a.values)) if p.strip()]


def ends_open(text: str) -> bool:
    """Whether a text ends without the mark of an end: no final punctuation, bracket, quote or symbol."""
    t = text.rstrip()
    if not t:
        return False
    last = t[-1]
    if last == "…":
        return len(t) > 1 and t[-2].isalnum()
    return last.isalnum() or last in ",;:-–—(/&" or last == "�"


def final_word(text: str) -> str:
    """The last word of a text, however far from its end."""
    end = len(text)
    while end and not text[end - 1].isalnum():
        end -= 1
    start = end
    while start and text[start - 1].isalnum():
        start -= 1
    w = words(text[start:end])
    return w[-1] if w else ""


def last_line(text: str) -> str:
    return text.rstrip().rsplit("\n", 1)[-1]


def is_item(text: str) -> bool:
    return bool(_ITEM.match(last_line(text)))


# What stands for an answer without being one, as words.
PLACEHOLDERS = {
    "n a", "na", "nan", "nil", "none", "null", "undefined", "empty", "blank", "no output", "no response", "no answer",
    "no content", "no data", "not available", "not applicable", "nothing", "json", "tbd", "todo", "void", "missing",
    "output", "response", "answer", "empty response", "empty output", "empty string", "redacted", "unknown",
}


def says_nothing(a: Answer) -> bool:
    """Whether nothing is said, whatever marks, placeholders or empty skeleton stand there."""
    if a.closed is False:
        return False
    return all(" ".join(words(p)) in PLACEHOLDERS or not words(p) for p in said(a))


# Function words of each language, and names of languages in each other.
FUNCTION_WORDS = {
    "en": "the and of to a in is it that for with on as was are be this have from or by not but what all were when we there can an your which their if will how each about up out them then she many some so these would into has more her two like him see time could no make than been who its now my made over did down only way find use may long very after words called just where most know through back much before well our and only then until while because since both under should remember leave against",
    "de": "der die das und in zu den mit von für auf ist im dem nicht ein eine einen einem einer als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn kann gegen vom können schon wir ihr dann unter soll ohne nimm gib denn weil während warum danach dazu dabei zwei drei",
    "fr": "le la les de des du un une et à en est que qui dans pour par sur pas plus ne se ce il au aux avec son sa ses ou mais comme nous vous leur cette ces être ont été sont aussi elle on tout même si puis sans entre après avant dont où fait peut très deux trois car quand pendant chez votre sous afin donc jusqu versez prenez",
    "es": "el la los las de del un una y en a que es por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos e esto antes algunos qué unos yo otro otra si luego mientras solo cada toma tras",
    "pt": "o a os as de do da dos das um uma e em no na nos nas que é por com para não se sua seu ao à como mais mas foi ele ela ou quando muito já também só pelo pela até isso entre depois sem mesmo aos seus quem esta esse num numa nem suas meu minha têm eles você enquanto antes sobre então pois são está deite tome duas",
    "nl": "de het een en van in is op te dat die voor met zijn niet aan er om ook als dan maar bij nog uit naar door over ze wat worden wordt kan meer of hij ik je tot geen deze dit heeft hebben we was al haar waar zo moet na onder want omdat terwijl daarna daarbij twee drie tegen hoe zonder laat giet neem",
    "it": "il lo la gli le di del della dei delle un una e che è in per con non si su da al alla come più ma anche sono nel nella questo questa quando molto senza dopo prima dove chi cosa già mentre perché tra fra se ci",
    "pl": "i w na z do że się nie to jest o jak ale po co tak za od jego jej ich przez dla czy był była było są być który która które oraz tylko już gdy może bez pod przed",
    "sv": "och i att det som en på är av för med den till inte har de ett om var jag men så från han nu kan hon vi vid över efter ut eller när där skulle ska utan mot",
    "da": "og i at det er en til af på for med den der som ikke de har et om var jeg men så fra han nu kan vi ved over efter ud eller når hvor skal uden mod blev",
}
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglês engels inglese",
    "de": "german deutsch allemand alemán aleman alemão alemao duits tedesco",
    "fr": "french französisch franzoesisch français francais francés frances francês frans francese",
    "es": "spanish spanisch espagnol español espanol castellano espanhol spaans spagnolo",
    "pt": "portuguese portugiesisch portugais portugués portugues português portugees portoghese",
    "nl": "dutch niederländisch niederlaendisch holländisch néerlandais neerlandais neerlandés holandés holandês neerlandês nederlands olandese",
    "it": "italian italienisch italien italiano italiaans",
    "pl": "polish polnisch polonais polaco polonês pools",
    "sv": "swedish schwedisch suédois sueco zweeds",
    "da": "danish dänisch danois danés dinamarquês deens",
}
_WORD_LANGUAGES: dict[str, list[str]] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in set(_ws.split()):
        _WORD_LANGUAGES.setdefault(_w, []).append(_l)
_NAMES = {n: l for l, ns in LANGUAGE_NAMES.items() for n in ns.split()}
_ASK = re.compile(
    r"\b(?:answer|reply|respond|write|say|explain|translate|antworte|antworten sie|schreib\w*|réponds|répondez|écris|écrivez|responde|responda|conteste|contesta|escribe|escriba|escreva|escreve|antwoord|schrijf|rispondi|scrivi)\b[^.!?;\n]{0,24}?\b(?:in|auf|en|em|in het|au|into)\s+(?:the\s+)?(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\b"
)
# Letters of each script, as ranges of characters.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "armenian": "Ա-֏", "hebrew": "א-״", "arabic": "ء-ۿݐ-ݿ", "devanagari": "ऄ-ॿ", "bengali": "ঀ-৿",
    "tamil": "ஂ-௿", "thai": "ก-๛", "georgian": "Ⴀ-ჿ", "kana": "ぁ-ヿ", "han": "㐀-䶿一-鿿", "hangul": "ᄀ-ᇿ가-힣",
}
_LETTERS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
#: Fewer letters than this don't show a script; signs that stand for words or syllables count threefold.
_LEAST, _HEAVY = 10, {"kana": 3, "han": 3, "hangul": 3}


def asked_language(prompt: str) -> str | None:
    """The language a prompt asks its answer to be in, if it names one."""
    m = _ASK.search(prompt.lower())
    return _NAMES[m.group(1)] if m else None


def language(ws: list[str]) -> tuple[str | None, float]:
    """The language whose function words weigh most, each shared among the languages that have it; and its lead over the next, in words."""
    score: dict[str, float] = {}
    for w in ws:
        ls = _WORD_LANGUAGES.get(w)
        if ls:
            for l in ls:
                score[l] = score.get(l, 0) + 1 / len(ls)
    if not score:
        return None, 0.0
    ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    return ranked[0][0], ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0)


def script(text: str) -> str | None:
    """The script most letters of a text are in; None where there are too few. Kana among Chinese characters make them Japanese."""
    if text.isascii():
        return "latin" if sum(map(str.isalpha, text)) >= _LEAST else None
    held = {k: len(r.findall(text)) * _HEAVY.get(k, 1) for k, r in _LETTERS.items()}
    if held["kana"] * 4 >= held["han"]:
        held["kana"], held["han"] = held["kana"] + held["han"] if held["kana"] else 0, held["han"] if not held["kana"] else 0
    most = max(held, key=held.get)
    return most if held[most] >= _LEAST else None
