"""Personal information in free text (problem 4): a semi-Markov conditional random field over whole spans.

Candidate spans of the five kinds are proposed by patterns of form (emails, phone and identity numbers,
addresses) and, for names, as runs of up to six word tokens that hold a likely name, follow a title, or are words no
text of the sample knows. A linear model scores each whole span by its form, its tokens and affixes, its length and the
words around it. The probability of a set of spans that don't overlap is exp(sum of its scores) / Z; a stretch outside
every mention scores 0. Training maximises the likelihood of the labelled sets: Z and the marginals come from forward
and backward sums over the lattice of candidates of each window (L-BFGS, ridge towards the start weights). Decoding is
bounded-entity dynamic programming: boundaries and kinds of all mentions of a window are chosen jointly.

Weights are trained on a bounded sample of the given texts (SAMPLE_TEXTS of each field, whole texts, by hash of the
key; SAMPLE_WINDOWS windows of them), labelled by cue rules and the names those rules yield, since the data carry no
labels. In every fifth window the names count as unknown words, so that form and context learn to do without a list.
Nothing depends on the order in which rows arrive: the sample is sorted as a whole. Weights are saved beside the
checkpoints under a digest of the sample and read again by later queries. Decoding runs over all texts.

Texts written with look-alike, wide or invisible characters are read in their canonical form; positions are
those of the stored text.

Defined results: null and empty texts have no mention and stay as they are; repeated rows are reported each;
very long texts are decoded window by window; where nothing was learned (no cue in the sample) the form
patterns still carry their initial weights.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from caselode.llm import canonical as canon
from caselode.operators import sampling
from caselode.session import ensure_checkpoint_dir
from caselode.sources import files

KINDS = ("email", "phone", "id_number", "address", "name")
SAMPLE_TEXTS = 2500
ROUNDS = 80
RIDGE = 0.1
SAMPLE_WINDOWS = 8000
MAX_NAME_TOKENS = 6
SEVERAL = 6
MODEL_VERSION = "2"

# Words and signs that mark kinds of mention in the four languages.
TITLES = "Dr|Prof|Mr|Mrs|Ms|Miss|Herr|Frau|Madame|Monsieur|Mme|M|Señora|Señor|Sra|Sr|Doña|Don"
PARTICLES = ("van", "von", "du", "de", "la", "der", "den", "del", "della", "da", "di", "ter", "zu")
NAME_CUES = (
    "name is|signed by|dictated by|countersigned by|collected by|pharmacy of|family of|cc:|from:|re:|next of kin:|"
    "according to|colleague|ask for|staying with|husband|wife|sister,|brother,|daughter,|son,|neighbour,|frère|hijo|"
    "sœur|under|that was|called|dear|signed,|sincerely,"
)
ID_CUES = (
    r"\bid\b|record number|record no|insurance|card says|mrn|social security|identity|passport|holder|dni|sécurité sociale|"
    "versicherung|krankenkasse|ausweis|identifier|patient number|patient no|hospital number|nhs|ssn|personnummer"
)
OTHER_CUES = "serial|lot |filed as|code|infusion|readings|ratio|protocol|trl|dated|acn|bed |room|form |specimen|register"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Close|Boulevard|Blvd|Way|Drive|Terrace|Place|Square|Crescent|Row|Mews|Hill|Grove"
PHONE_CUES = r"phone|call|\btel\b|fax|mobile|\bcell\b|reach|contact|dial|extension|handy|telefon|portable|téléphone|móvil|teléfono|appel|llam|anruf|ring"
#: what is called after a person, and so is none
CALLED_AFTER = "syndrome|disease|procedure|sign|test|hospital|clinic|clinical|centre|center|university|ward|unit|scale|score|operation|technique|maneuver|tumor|tumour|syndrom|krankheit|klinik|klinikum|hôpital|clinique|maladie|síndrome|enfermedad|clínica"
NUMBER_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zéro|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
# End of fixed values.

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_CAP_LETTERS = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’-])*(?!\w)"
_TOWN = rf"{_CAP_LETTERS}(?:[ -](?:{_CAP_LETTERS}|del|de|la|le|les|sur|sous|under|upon|am|an|der|of))*"
_TAIL = rf"(?:,? (?:(?:Apt|Apartment|Flat|Unit|Suite)\.? ?\w+|#\d+\w*|bajo|ático|\d{{1,2}}\.?º(?: [A-Z]\b)?|Hinterhaus|App\.? ?\d+))?"
_POSTCODE = r"(?:,? (?:[A-Z]{2} )?\d{5}(?:-\d{4})?(?!\d)|,? [A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b|, [A-Z]{2}\b)?"
_PLACE = rf"(?:(?: (?:NE|NW|SE|SW|N|S|E|W)\b\.?)?{_TAIL}(?:, (?:\d{{4,5}} )?{_TOWN})?{_POSTCODE})"
_ADDRESS = [
    rf"\b\d{{1,5}}[a-zA-Z]?,? (?:{_CAP} ){{1,4}}(?:{STREETS})\b(?:\.(?=,))?{_PLACE}",
    rf"\b\d{{1,4}}(?: ?(?:bis|ter|quater|[a-d]))?,? (?:rue|avenue|boulevard|impasse|chemin|allée|place|quai|cours|route|square|passage) (?:d[eu]s? |de la |de l['’]|d['’]|la |le |les )?{_CAP}(?:[ -]{_CAP})*{_PLACE}",
    rf"\b(?:{_CAP}(?:straße|strasse|str\.|weg|steg|gasse|platz|allee|ring|ufer|damm|hof)|(?:Am|Zum|Zur|Im|In der|An der|Auf dem|Unter den) {_CAP}) \d{{1,4}}(?: ?[a-z])?\b{_PLACE}",
    rf"\b(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Carretera|C/|Avda\.?) (?:del? |de la |de las |de los |la |el )?{_CAP}(?: {_CAP})*,? \d{{1,4}}\b{_PLACE}",
    rf"\b(?:P\. ?O\. ?|PO |P\.O\. |Post Office )Box \d{{1,6}}\b{_PLACE}",
]
_AT, _DOT = r"(?: ?@ ?| ?\[at\] ?| ?\(at\) ?)", r"(?:\.| ?\[dot\] ?| ?\(dot\) ?)"
_EMAIL = [
    rf"(?i)[a-z0-9à-ÿ][\w.+-]*{_AT}[a-z0-9][\w-]*(?:{_DOT}[a-z0-9-]+)+",
    r"(?i)[a-z0-9à-ÿ][\w.+-]*(?: dot [\w+-]+)* at [a-z0-9][\w-]*(?: dot [a-z0-9-]+)+",
]
_PHONE = [
    r"(?<![\w.,/-])(?:\+ ?|\()?\d[\d ./()-]{5,22}\d(?: ?(?:ext\.?|x|poste|Durchwahl) ?\d{1,5})?(?!\w)",
    rf"(?i)\b(?:{NUMBER_WORDS})(?:[ ,-]+(?:{NUMBER_WORDS})){{6,14}}\b",
]
_ID = [
    r"(?<![\w.,/-])(?:[A-Z]{1,3}-?)?\d[\d -]{3,22}\d(?:-?[A-Z])?(?!\w)",
    r"(?<![\w.,/-])(?=[A-Z\d]{0,13}[A-Z])(?=(?:[A-Z]*\d){4})[A-Z\d]{6,14}(?![\w-])",
]
_FORMS = {
    kind: [re.compile(p) for p in patterns]
    for kind, patterns in (("email", _EMAIL), ("phone", _PHONE), ("id_number", _ID), ("address", _ADDRESS))
}
_ANCHOR = re.compile(
    rf"@|\[at\]|\(at\)| dot |\d[\d ./()-]{{4,}}\d|\d{{5}}|\b(?:{NUMBER_WORDS}),? (?:{NUMBER_WORDS})\b|{_ID[1]}"
    rf"|\d[a-zA-Z]?,? (?:{_CAP} ){{1,4}}(?:{STREETS})\b|\d(?: ?(?:bis|ter|quater|[a-d]))?,? (?:rue|avenue|boulevard|impasse|chemin|allée|place|quai|cours|route|square|passage) "
    rf"|(?:straße|strasse|str\.|weg|steg|gasse|platz|allee|ring|ufer|damm|hof) \d|(?:Am|Zum|Zur|Im|In der|An der|Auf dem|Unter den) {_CAP} \d"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Carretera|C/|Avda\.?) |Box \d|\b(?:{TITLES})\.? {_CAP}|name is "
)
_TITLE = re.compile(TITLES)
_CALLED_AFTER = re.compile(CALLED_AFTER, re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:(?:-|['’](?=[A-ZÀ-Þ]))[^\W\d_]+)*|\d+|[^\w\s]")
_WORD = re.compile(r"[^\W\d_]+(?:(?:-|['’](?=[A-ZÀ-Þ]))[^\W\d_]+)*")
_PREVIOUS = re.compile(r"[^\W_]+|[^\w\s]")
_MAIL_SIGN = re.compile(r"@|\[at\]|\(at\)| dot ", re.I)
_SPELLED = re.compile(rf"\b(?:{NUMBER_WORDS})[ ,-]+(?:{NUMBER_WORDS})\b", re.I)
_FIVE_DIGITS = re.compile(r"\d\D{0,2}\d\D{0,2}\d\D{0,2}\d\D{0,2}\d")
_DIGIT = re.compile(r"\d")
_LONG_NUMBER = re.compile(r"\d[\d ./()-]{4,}\d")
#: What a window must hold for the forms of a kind to be worth trying.
_NEEDS = {("email", 0): _MAIL_SIGN, ("email", 1): _MAIL_SIGN, ("phone", 0): _FIVE_DIGITS, ("phone", 1): _SPELLED, ("id_number", 0): _FIVE_DIGITS}
LEFT, RIGHT, ROOM = 100, 200, 120


def canonical_offsets(text: str) -> tuple[str, list[int], list[int]]:
    """Canonical form, and break points (position in it, position in the text) of the stretches that moved."""
    if text.isascii() and not canon._PLAIN.search(text):
        return text, [0], [0]
    out, size, here, there, last = [], 0, [0], [0], 0
    table = canon.singles()
    for m in canon._STRETCH.finditer(text):
        part = m.group(0)
        if canon._stretch(part) == part:
            continue
        out.append(text[last : m.start()])
        size += m.start() - last
        i, n = 0, len(part)
        while i < n:
            j = i + 1
            while j < n and (unicodedata.combining(part[j]) or table.get(part[j]) == "" or (part[i] == "\r" and part[j] == "\n")):
                j += 1
            image = canon._stretch(part[i:j])
            if image:
                here.append(size)
                there.append(m.start() + i)
                out.append(image)
                size += len(image)
            i = j
        here.append(size)
        there.append(m.end())
        last = m.end()
    out.append(text[last:])
    return "".join(out), here, there


def stored_position(at: int, here: list[int], there: list[int]) -> int:
    i = bisect.bisect_right(here, at) - 1
    limit = there[i + 1] - 1 if i + 1 < len(there) else None
    found = there[i] + at - here[i]
    return found if limit is None else min(found, max(limit, there[i]))


def windows(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    """Stretches of the text around the anchors, within their lines, merged where they overlap."""
    out: list[tuple[int, int]] = []
    for at in sorted(set(anchors)):
        if out and at + ROOM < out[-1][1]:
            continue
        a, b = text.rfind("\n", max(0, at - LEFT), at) + 1 or max(0, at - LEFT), text.find("\n", at, at + RIGHT)
        b = min(len(text), at + RIGHT) if b < 0 else b
        while 0 < a < at and text[a - 1].isalnum() and text[a].isalnum():
            a += 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _since_number(before: str) -> str:
    """What stands between the last long number and here: a cue before that number was meant for it."""
    last = 0
    for m in _LONG_NUMBER.finditer(before):
        last = m.end()
    return before[last:]


def _shape(word: str) -> str:
    if word[0].isdigit():
        return "0"
    if not word[0].isalpha():
        return word
    if len(word) == 1:
        return "I" if word.isupper() else "i"
    return "C" if word.isupper() else "Cc" if word[0].isupper() else "c"


class Model:
    """Weights by feature; a span's score is the sum over its features."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights if weights is not None else {}
        self.known: dict[str, float] = {}
        self.looked: dict[str, bool] = {}

    # ---- tokens of names
    @staticmethod
    def token_features(word: str) -> tuple[str, ...]:
        low = word.lower()
        last = low.rsplit("-", 1)[-1]
        return ("t=" + low, "t.p3=" + low[:3], "t.p4=" + low[:4], "t.s3=" + last[-3:], "t.s4=" + last[-4:], "t.s5=" + last[-5:], "t.-")

    def token_score(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            get = self.w.get
            got = sum(get(f, 0.0) for f in self.token_features(word))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = got
        return got

    def sign(self, word: str) -> str:
        """What is known of a word: + a name, ~ likely one, - another word, ? nothing."""
        got = self.token_score(word)
        return "+" if got > 1 else "~" if got > 0 else "-" if self.w.get("k=" + word.lower()) else "?"

    def worth_a_look(self, text: str) -> list[str]:
        """Words of a text that may be names: likely ones, and capitalised ones that nobody knows."""
        out = []
        for w in set(_WORD.findall(text)):
            got = self.looked.get(w)
            if got is None:
                got = len(w) > 2 and (self.token_score(w) > 0 or (w[0].isupper() and self.sign(w) == "?"))
                if len(self.looked) > 300_000:
                    self.looked.clear()
                self.looked[w] = got
            if got:
                out.append(w)
        return out

    # ---- candidates and their features
    def candidates(self, s: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """(start, end, kind, features without those of name tokens) of all candidate spans of a window."""
        found = []
        for kind, forms in _FORMS.items():
            for i, form in enumerate(forms):
                if not _NEEDS.get((kind, i), _DIGIT).search(s):
                    continue
                for m in form.finditer(s):
                    a, b = m.span()
                    if kind == "phone" and i == 0:
                        if not 7 <= sum(c.isdigit() for c in m.group(0)) <= 18:
                            continue
                        if s[a] == "(" and ")" not in m.group(0):
                            a += 1
                    if kind == "id_number" and i == 0 and sum(c.isdigit() for c in m.group(0)) < 5:
                        continue
                    found.append((a, b, kind, self._number_features(s, a, b, kind, i)))
        mails = [(a, b) for a, b, kind, _ in found if kind == "email"]
        found.extend(c for c in self._names(s) if not any(c[0] < b and a < c[1] for a, b in mails))
        return found

    @staticmethod
    def _around(s: str, a: int, b: int, k: str) -> list[str]:
        left = _PREVIOUS.findall(s[max(0, a - 45) : a].lower())[-4:]
        right = _PREVIOUS.findall(s[b : b + 25].lower())[:2]
        out = [f"{k}.b={w}" for w in left if not w.isdigit()]
        out.append(f"{k}.l={left[-1] if left else '^'}")
        out.append(f"{k}.ll={' '.join(left[-2:])}")
        out.append(f"{k}.r={right[0] if right else '$'}")
        return out

    def _number_features(self, s: str, a: int, b: int, kind: str, form: int) -> tuple[str, ...]:
        k = kind[0]
        span = s[a:b]
        out = [f"{k}.form={form}"]
        if kind in ("phone", "id_number"):
            out.append(f"{k}.shape={re.sub(r'[A-Z]', 'A', re.sub(r'[0-9]', '0', span))[:24]}")
            out.append(f"{k}.head={span[:2] if span[0] in '+0' else re.sub('[0-9]', '0', span[:2])}")
            out.append(f"{k}.digits={sum(c.isdigit() for c in span)}")
            before = _since_number(s[max(0, a - 60) : a].lower())
            for name, cues in (("id", ID_CUES), ("other", OTHER_CUES), ("phone", PHONE_CUES)):
                if re.search(cues, before):
                    out.append(f"{k}.cue={name}")
        return tuple(out + self._around(s, a, b, k))

    def _names(self, s: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
        tokens = [(m.group(0), m.start(), m.end()) for m in _TOKEN.finditer(s)]
        n, found = len(tokens), []
        word = [t[0][0].isalpha() for t in tokens]
        shape = [_shape(t[0]) for t in tokens]
        signs = [self.sign(t[0]) if word[i] and shape[i] not in "Ii" else "" for i, t in enumerate(tokens)]
        hot = [x in ("+", "~") for x in signs]
        new = [x == "?" and shape[i] in ("Cc", "C") for i, x in enumerate(signs)]  # capitalised, and no text knows it
        cued = [m.end() for m in re.finditer(rf"(?:\b(?:{TITLES})\.?|name is) ", s)]
        for i in range(n):
            if not word[i] or (i and tokens[i - 1][0] in "/×" and tokens[i - 1][2] == tokens[i][1]):
                continue
            if len(tokens[i][0]) > 1 and _TITLE.fullmatch(tokens[i][0]) and not hot[i]:
                continue
            # a segment: words with blanks, hyphens, a full stop after an initial or a comma (last name first) between
            j, used, live = i, 0, False
            while j < n and used < MAX_NAME_TOKENS:
                if word[j]:
                    used += 1
                    live = live or hot[j] or (tokens[j][1] in cued and shape[j] in ("Cc", "C")) or new[j]
                    if live and (hot[j] or tokens[i][1] in cued or shape[j] in ("Cc", "C")) and shape[j] not in "Ii":
                        found.append((tokens[i][1], tokens[j][2], "name", self._name_features(s, tokens, shape, signs, i, j)))
                    step = j + 1
                    if step < n and tokens[step][0] == "." and shape[j] == "I":
                        step += 1
                    elif step < n and tokens[step][0] == "," and used == 1 and shape[j] in ("Cc", "C") and (hot[j] or new[j]):
                        step += 1
                    if step >= n or not word[step] or s[tokens[step - 1][2] : tokens[step][1]] != " ":
                        break
                    # only names, initials and particles go on
                    if not (hot[step] or shape[step] in ("I", "Cc", "C") or tokens[step][0].lower() in PARTICLES):
                        break
                    j = step
                else:
                    break
        return found

    def _name_features(self, s: str, tokens: list, shape: list[str], signs: list[str], i: int, j: int) -> tuple[str, ...]:
        a, b = tokens[i][1], tokens[j][2]
        parts = []
        names = 0
        for k in range(i, j + 1):
            t = tokens[k][0]
            if t.lower() in PARTICLES and t.islower():
                parts.append("p")
            elif t in ".,":
                parts.append(t)
            else:
                parts.append(shape[k] + (signs[k] if shape[k] != "I" else ""))
                names += 1
        form = " ".join(parts)
        # spans with a known part and spans without any are read by separate weights
        p = "n+" if any(x[-1] in "+~" for x in parts) else "n?" if any(x[-1] == "?" for x in parts) else "n-"
        out = [f"{p}.form={form}", f"{p}.count={names}", f"{p}.first={parts[0]}", f"{p}.last={parts[-1]}"]
        before, after = tokens[i - 1][0] if i else "^", tokens[j + 1][0] if j + 1 < len(tokens) else "$"
        second = tokens[i - 2][0] if i > 1 else "^"
        plain = lambda at: "<name>" if signs[at] in ("+", "~") else tokens[at][0].lower()
        left, right, far = plain(i - 1) if i else "^", plain(j + 1) if j + 1 < len(tokens) else "$", plain(i - 2) if i > 1 else "^"
        if before == "." and second.isalpha():
            out.append(f"{p}.title={second.lower()}" if len(second) > 1 and re.fullmatch(TITLES, second) else f"{p}.initial" if len(second) == 1 and not (i > 2 and tokens[i - 3][0] == "/") else f"{p}.stop")
        if (before == "." and _TITLE.fullmatch(second)) or (len(before) > 1 and _TITLE.fullmatch(before)):
            out.append(f"{p}.titled")
        out.append(f"{p}.l={left}")
        out.append(f"{p}.ll={far} {left}")
        out.append(f"{p}.r={right}")
        if _CALLED_AFTER.fullmatch(after) or _CALLED_AFTER.fullmatch(tokens[j][0]):
            out.append("n.after")
        out.append(f"{p}.lhot={int(i > 0 and before.isalpha() and self.token_score(before) > 0)}")
        out.append(f"{p}.rhot={int(after.isalpha() and self.token_score(after) > 0)}")
        if s[a - 1 : a] in "@+_" and a or s[b : b + 1] in ("@", "+", "_") or re.match(r"[\w.+-]*(?: ?@| ?[\[(]at[\])]| at \w+ dot )", s[b : b + 40]):
            out.append("n.mail")
        return tuple(out)

    def decode(self, spans: list) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """The likeliest set of non-overlapping candidates of a window."""
        get = self.w.get
        scored = []
        for a, b, kind, feats in spans:
            score = sum(get(f, 0.0) for f in feats)
            if score > 0:
                scored.append((b, a, score, kind, feats))
        if not scored:
            return []
        scored.sort(key=lambda x: (x[0], x[1]))
        ends = [x[0] for x in scored]
        best, take = [0.0] * (len(scored) + 1), [False] * len(scored)
        back = [0] * len(scored)
        for i, (_, a, score, *_rest) in enumerate(scored):
            back[i] = bisect.bisect_right(ends, a, 0, i)
            if best[back[i]] + score > best[i]:
                best[i + 1], take[i] = best[back[i]] + score, True
            else:
                best[i + 1] = best[i]
        out, i = [], len(scored)
        while i:
            if take[i - 1]:
                b, a, _, kind, feats = scored[i - 1]
                out.append((a, b, kind, feats))
                i = back[i - 1]
            else:
                i -= 1
        return out[::-1]


class Unknowing(Model):
    """A model that has forgotten all names and a third of the other words (by digest)."""

    def token_score(self, word: str) -> float:
        return -1.0

    def sign(self, word: str) -> str:
        low = word.lower()
        return "-" if self.w.get("k=" + low) and hashlib.blake2b(low.encode("utf-8", "surrogatepass")).digest()[0] % 3 else "?"


# ---------------------------------------------------------------- training

_TITLED = re.compile(rf"\b(?:{TITLES})\.? ((?:[A-ZÀ-ÖØ-Þ]\. )?(?:{_CAP} )?(?:[A-ZÀ-ÖØ-Þ]\. )?(?:(?:van|von|du|de la) )?{_CAP})")
_CUED = re.compile(rf"(?:(?i:{NAME_CUES})) ((?:{_CAP}|[A-ZÀ-ÖØ-Þ]\.)(?:,? (?:(?:van|von|du|de la) )?(?:{_CAP}|[A-ZÀ-ÖØ-Þ]\.)){{1,2}})")


def _without_mails(t: str) -> str:
    """A text without the surroundings of signs of email, whose parts are no running words."""
    marks = [m.start() for m in _MAIL_SIGN.finditer(t)]
    ends = [0, *(at + 45 for at in marks)]
    return " ".join(t[a : max(a, b - 35)] for a, b in zip(ends, [*marks, len(t) + 35]))


def name_lexicon(texts: list[str]) -> tuple[set[str], set[str]]:
    """Words that stand in name positions in at least a quarter of their uses, addresses of email left out; and all
    words that ever stand there."""
    cued, total = Counter(), Counter()
    for t in texts:
        total.update(w.lower() for w in _WORD.findall(_without_mails(t)))
        for form in (_TITLED, _CUED):
            for m in form.finditer(t):
                if "@" in t[m.end() : m.end() + 2]:
                    continue
                cued.update(w.lower() for w in _WORD.findall(m.group(1)) if len(w) > 1 and w not in PARTICLES)
    return {w for w, c in cued.items() if 4 * c >= total[w] and (c > 1 or total[w] < 4)}, set(cued)


def weak_labels(s: str, names: set[str], model: Model) -> set[tuple[int, int, str]]:
    """Precise labels of a window by cue and form."""
    gold: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y, _ in gold)

    for kind in ("email", "address"):
        for i, form in enumerate(_FORMS[kind]):
            if _NEEDS.get((kind, i), _DIGIT).search(s):
                gold.extend((m.start(), m.end(), kind) for m in form.finditer(s) if free(*m.span()))
    gold.extend((*m.span(), "phone") for m in _FORMS["phone"][1].finditer(s) if free(*m.span()))
    numbers = [c for c in model.candidates(s) if c[2] in ("phone", "id_number")]
    for a, b, kind, _ in sorted(numbers, key=lambda c: (c[0], -c[1])):
        before = _since_number(s[max(0, a - 42) : a].lower())
        other = [m.end() for m in re.finditer(OTHER_CUES, before)]
        ids = [m.end() for m in re.finditer(ID_CUES, before)]
        sure = (ids or [0])[-1] > (other or [0])[-1]
        digits = sum(c.isdigit() for c in s[a:b])
        named = re.search(PHONE_CUES, before) is not None
        wanted = "id_number" if sure else None if other or (digits < 8 and not named) else "phone"
        if kind == wanted and free(a, b):
            gold.append((a, b, kind))
    tokens = [(m.group(0), m.start(), m.end()) for m in _TOKEN.finditer(s)]
    i = 0
    while i < len(tokens):
        low = tokens[i][0].lower()
        initial = len(low) == 1 and tokens[i][0].isupper() and i + 2 < len(tokens) and tokens[i + 1][0] == "." and tokens[i + 2][0].lower() in names
        if not (low in names or initial):
            i += 1
            continue
        j = i
        while True:
            step = j + 1
            while step < len(tokens) and step - j < 4 and (tokens[step][0] in ".," or tokens[step][0].lower() in PARTICLES or (len(tokens[step][0]) == 1 and tokens[step][0].isupper())):
                if tokens[step][0] == "," and not (step == j + 1 and j == i):
                    step = len(tokens)
                    break
                if tokens[step][0] == "." and not (len(tokens[step - 1][0]) == 1 and tokens[step - 1][0].isalpha()):
                    step = len(tokens)
                    break
                step += 1
            if step < len(tokens) and tokens[step][0].lower() in names and tokens[step][1] - tokens[step - 1][2] == 1:
                j = step
            else:
                break
        if free(tokens[i][1], tokens[j][2]) and not re.match(r"[\w.+-]*(?: ?@| ?[\[(]at| at \w+ dot )", s[tokens[j][2] : tokens[j][2] + 30]):
            gold.append((tokens[i][1], tokens[j][2], "name"))
        i = j + 1
    return set(gold)


def _initial() -> dict[str, float]:
    """Start weights: forms that are sure by themselves."""
    return {"e.form=0": 2.0, "e.form=1": 2.0, "p.form=1": 2.0, "a.form=0": 1.0, "a.form=1": 1.0, "a.form=2": 1.0, "a.form=3": 1.0, "i.cue=id": 1.0, "i.cue=other": -2.0, "p.cue=other": -2.0, "n.mail": -3.0, "n.after": -12.0}


def token_weights(words: Counter, names: set[str], n_texts: int, epochs: int = 12) -> dict[str, float]:
    """Logistic regression over word forms: is it part of a name? Identity is left out half of the time, so affixes learn."""
    w: dict[str, float] = defaultdict(float)
    # rare forms may be names no cue has shown: they teach nothing
    rare = max(3, n_texts // 200)
    forms = sorted((w for w, n in words.items() if w in names or n > rare), key=hash_of)
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for k, word in enumerate(forms):
            feats = Model.token_features(word)
            feats = feats[1:] if (k + epoch) % 2 else feats
            target = word in names
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in feats)))))
            step = rate * (target - p) * (3 if target else 1)
            if abs(step) > 1e-3:
                for f in feats:
                    w[f] += step
    return {f: round(v, 4) for f, v in w.items()}


class Lattices:
    """The candidates of many windows, by end; windows of like size are summed over together."""

    def __init__(self, windows: list[list]):
        self.groups = []
        first = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int64)
        sizes: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(windows):
            if w:
                sizes[1 << (len(w) - 1).bit_length()].append(i)
        for size, members in sorted(sizes.items()):
            place, back = np.full((len(members), size), -1, dtype=np.int64), np.zeros((len(members), size), dtype=np.int64)
            for row, i in enumerate(members):
                order = sorted(range(len(windows[i])), key=lambda j: (windows[i][j][1], windows[i][j][0]))
                ends = [windows[i][j][1] for j in order]
                place[row, : len(order)] = first[i] + np.array(order)
                back[row, : len(order)] = [bisect.bisect_right(ends, windows[i][j][0], 0, at) for at, j in enumerate(order)]
            self.groups.append((place, back))

    def marginals(self, scores: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of log Z over the windows, probability of each candidate): forward and backward sums over segments."""
        total, out = 0.0, np.zeros(len(scores))
        for place, back in self.groups:
            there = place >= 0
            s = np.where(there, scores[place], -np.inf)
            rows, n = np.arange(len(place)), place.shape[1]
            forward = np.zeros((len(place), n + 1))
            for i in range(n):
                forward[:, i + 1] = np.logaddexp(forward[:, i], forward[rows, back[:, i]] + s[:, i])
            total += float(forward[:, n].sum())
            mass, p = np.zeros((len(place), n + 1)), np.zeros_like(s)
            mass[:, n] = 1.0
            for i in range(n - 1, -1, -1):
                share = np.exp(forward[rows, back[:, i]] + s[:, i] - forward[:, i + 1])
                p[:, i] = mass[:, i + 1] * share
                mass[rows, back[:, i]] += p[:, i]
                mass[:, i] += mass[:, i + 1] * (1 - share)
            out[place[there]] = p[there]
        return total, out


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a step halved until the value falls enough."""
    value, grad = f(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, left = grad.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            left.append(a)
            q -= a * y
        if steps:
            s, y, rho = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(steps, reversed(left)):
            q += s * (a - rho * (y @ q))
        slope, size = -(grad @ q), 1.0 if steps else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))
        while size > 1e-8:
            new = w - size * q
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - w, new_grad - grad
        if s @ y > 1e-10:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


def fit_weights(windows: list[list], gold: list[set], start: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """Weights of greatest likelihood of the labelled sets of spans, less a ridge around the start weights."""
    spans = [c for w in windows for c in w]
    names = sorted({f for c in spans for f in c[3]})
    number = {f: i for i, f in enumerate(names)}
    sizes = np.array([len(c[3]) for c in spans], dtype=np.int64)
    flat = np.array([number[f] for c in spans for f in c[3]], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    want = np.zeros(len(spans))
    at = 0
    for found, wanted in zip(windows, gold):
        held: set = set()
        for k, (a, b, kind, _) in enumerate(found):
            if (a, b, kind) in wanted and (a, b, kind) not in held:
                held.add((a, b, kind))
                want[at + k] = 1.0
        at += len(found)
    if not len(spans):
        return dict(start)
    lattices = Lattices(windows)
    middle = np.array([start.get(f, 0.0) for f in names])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scores = np.add.reduceat(w[flat], bounds)
        total, p = lattices.marginals(scores)
        pull = w - middle
        grad = np.bincount(flat, weights=np.repeat(p - want, sizes), minlength=len(w)) + RIDGE * pull
        return total - float(scores @ want) + RIDGE / 2 * float(pull @ pull), grad

    w = minimise(loss, middle.copy(), rounds)
    return {**start, **{f: round(float(x), 4) for f, x in zip(names, w) if abs(x) > 5e-4}}


def _told(s: str, spans: list, gold: set, names: set[str], model: Model) -> tuple[list, set]:
    """The candidates and labels of a window that the cues speak about.

    A word that no cue has shown and that is not known otherwise is left out with every label it touches: it may be either.
    """
    unsure = [
        (a, b) for a, b, kind, _ in spans
        if kind == "name" and any(w.lower() not in names and "k=" + w.lower() not in model.w for w in _WORD.findall(s[a:b]) if len(w) > 1)
    ]
    if not unsure:
        return spans, gold
    free = lambda a, b: all(b <= x or y <= a for x, y in unsure)
    return [c for c in spans if c[2] != "name" or free(c[0], c[1])], {g for g in gold if g[2] != "name" or free(g[0], g[1])}


def train(texts: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Weights of tokens and spans from a sample of canonical texts, whatever their order."""
    texts = sorted({t for t in texts if t})
    names, cued = name_lexicon(texts)
    words, small = Counter(), set()
    for t in texts:
        found = set(_WORD.findall(_without_mails(t)))
        words.update({w.lower() for w in found if len(w) > 1})
        small.update(w for w in found if w.islower())
    tokens = token_weights(words, names, len(texts))
    # words the sample knows as other words than names: written small somewhere, or in SEVERAL texts and never in a cue
    known = {f"k={w}": 1.0 for w, n in words.items() if w not in names and (w in small or (n >= SEVERAL and w not in cued))}
    model = Model({**_initial(), **tokens, **known})
    seen: dict[str, str] = {}
    for k, t in enumerate(texts):
        anchors = [m.start() for m in _ANCHOR.finditer(t)]
        for w in sorted(set(_WORD.findall(t))):
            if len(w) > 1 and (w.lower() in names or model.token_score(w) > 0 or (w[0].isupper() and model.sign(w) == "?")):
                anchors.append(t.find(w))
        if k % 3 == 0:
            anchors.append((k * 7919) % len(t))  # and some plain text
        for a, b in windows(t, anchors):
            s = t[a:b]
            form = re.sub(r"\d", "0", s)
            if form not in seen or s < seen[form]:
                seen[form] = s
    data = sorted(seen.values(), key=hash_of)[:SAMPLE_WINDOWS]
    gold = [weak_labels(s, names, model) for s in data]
    # in every fifth window names, and a third of the other words, are words nobody knows: titles, cues, shapes and
    # neighbours learn to tell them apart without a list
    unknowing = Unknowing(model.w)
    both = [_told(s, (unknowing if i % 5 == 0 else model).candidates(s), gold[i], names, model) for i, s in enumerate(data)]
    return fit_weights([spans for spans, _ in both], [wanted for _, wanted in both], model.w, rounds)


def hash_of(s: str) -> str:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() + s


# ---------------------------------------------------------------- running over texts

def mentions(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all mentions in a stored text."""
    plain, here, there = canonical_offsets(text)
    anchors = [m.start() for m in _ANCHOR.finditer(plain)]
    for w in model.worth_a_look(plain):
        at = plain.find(w)
        while at >= 0:
            anchors.append(at)
            at = plain.find(w, at + len(w))
    out = []
    for a, b in windows(plain, anchors):
        for x, y, kind, _ in model.decode(model.candidates(plain[a:b])):
            out.append((stored_position(a + x, here, there), stored_position(a + y - 1, here, there) + 1, kind))
    return out


def fit(samples: list[DataFrame]) -> dict[str, float]:
    """Train on SAMPLE_TEXTS texts of each frame (row_key, text), chosen by hash of the key.

    Weights are saved beside the checkpoints under a digest of the sample: the same sample is trained on once.
    """
    texts: list[str] = []
    for df in samples:
        told = df.select("row_key", "text").where("row_key is not null and length(text) > 0")
        texts += [r["text"] for r in sampling.bounded_sample(told, "row_key", SAMPLE_TEXTS).select("text").collect()]
    digest = hashlib.blake2b(MODEL_VERSION.encode(), digest_size=16)
    for t in sorted(texts):
        digest.update(hashlib.blake2b(t.encode("utf-8", "surrogatepass")).digest())
    spark = samples[0].sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pii-weights/{digest.hexdigest()}"
    if files._exists(spark, f"{path}/_SUCCESS"):
        return {r["feature"]: r["weight"] for r in spark.read.parquet(path).collect()}
    weights = train([canon.canonical(t) for t in texts])
    spark.createDataFrame(sorted(weights.items()), "feature string, weight double").coalesce(1).write.mode("overwrite").parquet(path)
    return weights


def find_mentions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Of (field_name, row_key, text): one row per mention with pii_kind, start_at and end_at in the stored text."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    key = df.schema["row_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value)
        for batch in batches:
            rows = [
                (field, k, kind, a, b)
                for field, k, t in zip(batch["field_name"], batch["row_key"], batch["text"])
                if t
                for a, b, kind in mentions(t, model)
            ]
            yield pd.DataFrame(rows, columns=["field_name", "row_key", "pii_kind", "start_at", "end_at"])

    return df.where("text is not null").mapInPandas(run, f"field_name string, row_key {key}, pii_kind string, start_at int, end_at int")


def redacted(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Of (field_name, row_key, text): the text with each mention as [KIND]; null stays null."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    key = df.schema["row_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value)
        for batch in batches:
            out = []
            for t in batch["text"]:
                if t:
                    parts, last = [], 0
                    for a, b, kind in mentions(t, model):
                        parts += [t[last:a], f"[{kind.upper()}]"]
                        last = b
                    t = "".join([*parts, t[last:]])
                out.append(t)
            yield batch.assign(text=out)

    return df.select("field_name", "row_key", "text").mapInPandas(run, f"field_name string, row_key {key}, text string")
