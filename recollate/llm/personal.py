"""Personal information inside free text: spans of email addresses, phone and identity numbers, street addresses and names.

1. Generators propose spans with high recall; proposals may overlap.
2. One boosted-tree model per kind scores a proposal from its format and its context.
3. A threshold per kind, calibrated on held-out cases, selects; among overlapping spans the likeliest wins, the longer of equals.

No labelled text comes with the data, so the models learn from a made-up sample (``training_text``, of a fixed size given by
``SAMPLE``) of mentions and look-alikes in letters, forms, chats and logs of five languages, in wording written for this purpose; seed and size
are parameters.

Positions count characters (code points) from 0, ends are exclusive. Null and empty texts have no mention; repeated rows give
repeated rows; other columns are ignored. An email's local part has at most 64 characters by the mail standard (RFC 5321), written
out at most ``LOCAL``; a street's name is sought ``STREET`` characters before its number.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollate.llm.boosting import Trees, best_threshold, fit_trees

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
SAMPLE, SEED = 9000, 7
LOCAL, STREET = 320, 100

# Letters of the Latin, Greek and Cyrillic scripts by case, with combining accents among the lower ones.
_RANGE = [chr(c) for c in range(0x41, 0x530)] + [chr(c) for c in range(0x1E00, 0x1F00)]
_UP = "".join(c for c in _RANGE if c.isupper())
_LOW = "".join(c for c in _RANGE if c.islower()) + "̀-ͯ"
_HAN = "一-鿿"
#: A capitalised word: O'Connor, McCarthy, Jean-Luc, D'Angelo.
_CAP = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:['’-]?[{_UP}][{_LOW}]+)*"
_CAPS = rf"[{_UP}]{{2,}}(?:['’-][{_UP}]{{2,}})*"

# Every scanner starts with a character class, so that it skips ahead quickly; what must not stand before it is checked after.
_AT = re.compile(r"@| ?[(\[{<] ?(?:at|AT|arroba|chez) ?[)\]}>] ?| (?:at|AT|arroba) ")
_DOT = r"(?: ?[(\[{<] ?(?:dot|DOT|punkt|punto|point) ?[)\]}>] ?|\.)"
_SAID = r" (?:dot|DOT|punkt|punto) "
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = re.compile(rf"(?<![\w.%+@-])[^\W_](?:[\w.%+'-]|{_DOT})*$")
_LOCAL_SAID = re.compile(rf"(?<![\w.%+@-])[^\W_](?:[\w.%+'-]|{_SAID})*$")
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9-])")
_DOMAIN_SAID = re.compile(rf"{_LABEL}(?:{_SAID}{_LABEL})*{_SAID}[A-Za-z]{{2,}}(?![A-Za-z0-9-])")
_PHONE = re.compile(r"[+(0-9](?:(?<=\+) ?\d{1,15}|(?<=\()\d{1,5}\)|(?<=\d)\d*)(?:[ ./-]{0,2}\(\d{1,5}\)|(?<=\)) ?\d+|[ ./-]{1,2}\d+){0,8}(?!\w|[./-]\d|-\w)")
_ID = re.compile(r"(?:[A-Z]{2} (?=\d\d \d\d \d\d)|[A-Z]{0,2})\d+(?:[ /-]?\d{2,}){0,5}(?:[ -]?[A-Z](?!\w))?(?![\w]|[./-]\d)")
_MIXED = re.compile(r"[A-Z0-9]{7,18}(?!\w|[./-]\d)")
_STOP = r"(?!(?:Passport|Steuer|Tax|National|Social|Pass|Personal|Insurance|Phone|Tel|Email|Mobile|SSN|DNI|NIE|Mr|Mrs|Ms|Dr)\b)"
_TOWN = rf"(?:, (?:\d{{4,6}} )?{_STOP}{_CAP}(?:[ -]{_CAP}){{0,2}}(?: [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}|,? [A-Z]{{2}} \d{{5}})?)?(?! ?[\d:#]|-\w)"
# Words that end or begin the names of streets.
_TYPES = (
    "Street St Road Rd Avenue Ave Lane Ln Drive Dr Close Court Ct Terrace Place Pl Square Sq Way Gardens Grove Crescent Boulevard Blvd Hill Row Mews Walk Parade Esplanade Quay Wharf Circle Parkway Pkwy Pike Trail Alley View "
    "Rise Green Vale Loop Plaza Highway Hwy Embankment Promenade Parkway Wynd Broadway Circus Yard Passage Bridge Causeway Turnpike"
).split()
_TYPE = frozenset(_TYPES)
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite)"
_EN_AT = re.compile(rf"\d{{1,5}}[A-Za-z]? (?=[{_UP}])")
_EN_WORD = re.compile(rf"{_CAP}(?:'s)?(?!\w)")
_SHORT = frozenset("St Ave Ct Ln Blvd Dr Pl Sq Hwy Pkwy".split())
_FLAT_AFTER = re.compile(rf", {_FLAT} \d+[A-Za-z]?")
_FLAT_BEFORE = re.compile(rf"{_FLAT} \d+[A-Za-z]?, $")
_TOWN_AFTER = re.compile(_TOWN)
_DE_AT = re.compile(rf"[{_LOW}.] (?=\d)")
_DE_ENDS = ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer", "steig", "pfad", "chaussee", "straat", "laan", "gracht", "plein", "kade", "gatan", "vägen", "gade", "vej")
_DE_NAME = re.compile(rf"(?:(?:Am|An der|Im|Zum|Zur|Auf der|Unter den|Alte[rs]?|Neue[rs]?|Große[rs]?|Kleine[rs]?|{_CAP}er) )?[{_UP}][\w]*(?:-[{_UP}]\w*)*\.?$|(?:{_CAP} )+Stra(?:ß|ss)e$")
_DE = re.compile(rf" \d{{1,4}}[a-z]?\b(?:, (?:Whg\.|Wohnung|\d+\. OG)(?: \d+)?)?{_TOWN}")
_HEADS = "Calle Avenida Avda. Plaza Paseo Camino Ronda C/ Via Viale Piazza Corso Rua Praça Travessa".split()
_ES_AT = re.compile(r"(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda|C/|Via|Viale|Piazza|Corso|Rua|Praça|Travessa) (?=\w)")
_ES = re.compile(rf"(?:de |del |la |las |los |el |da |do |dos |della |{_CAP} ?){{1,6}}(?<! ),? \d{{1,4}}\b(?:, (?:\d+[ºª°][A-Z]?|piso \d+|bajo)(?: [A-Z]\b)?)?{_TOWN}")
_FR = re.compile(rf"\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|quai|impasse|allée|chemin|route|cours|Rue|Avenue|Boulevard|Place|Quai|Impasse|Allée|Chemin|Route|Cours) (?:de la |de l'|du |des |de |d'|la |le )?{_CAP}(?:[ -]{_CAP}){{0,3}}{_TOWN}")
_ZH = re.compile(rf"[{_HAN}]{{2,16}}?(?:路|街|大道|巷|胡同)\d+号(?:[{_HAN}\d]{{0,8}}(?:室|楼|单元))?")
_TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Sra?|Don|Doña|Señora?|Hr|Fr|Mme|Sir|Lady)\.?"
_TITLE_END = re.compile(rf"(?:(?<![\w.])|(?<=\\n)|(?<=\\t)){_TITLE} $")
_NAME_TOKEN = re.compile(rf"{_CAP}|{_CAPS}|[{_UP}]\.")
_LINKS = frozenset(f" {x} " for x in ("van", "von", "de", "der", "den", "la", "da", "dos", "del", "di", "bin", "al", "van den", "van de", "van der", "von der", "de la", "de los", "y", "zu"))
# The most frequent Chinese family names, and words beside a Chinese name.
_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_ZH_BEFORE = ("联系人", "联系", "姓名", "叫做", "名叫", "我是", "经理", "老师", "医生", "收件人", "签名", "客户", "同事", "患者", "作者", "：", ":")
_ZH_AFTER = ("先生", "女士", "小姐", "老师", "经理", "医生", "教授", "同学")
_ZH_NAME = re.compile(rf"[{_SURNAMES}][{_HAN}]{{1,2}}")

# Words that announce a kind, or a look-alike, before or after a span.
CUES = {
    "phone": "call phone mobile tel telephone cell fax dial contact ring whatsapp number desk telefon handy móvil teléfono sms text reach hotline rang nummer llama phoned calls landline pager portable",
    "id": "ssn social security passport tax insurance national dni nie nif id steuer-id ni pass ausweis identity pasaporte taxpayer vat licence license personalausweis reisepass identidad",
    "code": "order build sensor version ticket port commit chapter invoice release issue step row rows entries items copies run runs v rev revision batch serial job page model sku isbn tracking parcel flight room table section episode season article item code part lot track ms units gate exit error line lines",
    "name": "contact owner record met ask by from for is with and dear hi cc signed tell told called said thanks ping assign author assignee regards visited invited hello mr named sincerely colleague tenant patient client born wrote",
    "place": "lives at to address deliver moved near in office home wohnt vive living located residence visit lived anschrift adresse dirección reside house wohnhaft",
    "title": "mr mrs ms miss dr prof herr frau sr sra don doña señor señora hr fr mme sir lady",
    "article": "the a an der die das el la los this each every its their our las dem den les le une",
}
_CUE = {k: frozenset(v.split()) for k, v in CUES.items()}
# Given names that are common in many countries.
_GIVEN = frozenset(
    "anna maria peter john david michael paul thomas james robert mary elena sofia laura julia sarah emma lucas martin daniel andrea marco luca giulia chiara paolo carlos jose josé juan luis miguel ana carmen lucia isabel pablo diego "
    "hans klaus jürgen karl stefan petra sabine monika ursula greta lena max felix jan piotr katarzyna tomasz ivan olga dmitri natasha sergei yuri anton nina vera igor pierre jean marie claire louis camille chloé antoine sophie ahmed "
    "mohamed fatima omar aisha yusuf leila hassan ali ravi priya arjun anita raj sunita wei li ming yuki kenji hiroshi sakura haruto min-jun ji-woo kim linda susan karen patricia jennifer elizabeth william richard charles joseph george "
    "edward henry alice grace rose kate jane helen ruth clara oscar hugo emil erik lars ingrid astrid sven björn anders mateo santiago valentina camila gabriel rafael pedro joão kwame amara chidi zanele noah liam olivia ava mia ethan".split()
)
# Frequent words that begin a sentence or a title rather than a name.
_COMMON = frozenset(
    "the a an and or but if when while after before since until because please note use see our your my his her its their this that these those we you they he she it i in on at to for from with by of is are was were will can could "
    "should would must may might do does did has have had not no yes all each every some any many more most other new old first last next today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday january "
    "february march april may june july august september october november december januar februar märz mai juni juli oktober dezember enero mayo junio julio agosto project team group meeting section market review report plan planning control budget company office ministry department north south east west great "
    "big small company bank hotel school university street road avenue lane number phone email address passport tax security insurance id dear hello hi thanks regards best call tell ask send write contact meet der die das und oder "
    "wenn nach vor seit bitte am im für mit von zu ein eine el la los las y o si cuando después para con del un una le les et ou si quand après pour avec du des un une let make keep take give get go come read show set add find remember".split()
)
_TOK = re.compile(rf"[^\W_]+(?:-[^\W_]+)*|[@(),.:;/#]")
_JOINED = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/.-@")
_ESCAPED = frozenset(("\\n", "\\t", "\\r"))


def _joined(text: str, a: int) -> bool:
    """Whether something before a belongs to the same word; a line break escaped in JSON text doesn't."""
    return a > 0 and (text[a - 1] in _JOINED or text[a - 1].isalnum()) and text[max(0, a - 2) : a] not in _ESCAPED


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _AT.finditer(text):
        i, j = m.span()
        spoken = m[0][-1] == " " and m[0][0] == " " and m[0].strip().isalpha()
        right = (_DOMAIN_SAID if spoken else _DOMAIN).match(text, j)
        if right:
            base = max(0, i - LOCAL)
            left = (_LOCAL_SAID if spoken else _LOCAL).search(text[base:i])
            if left:
                start = base + left.start()
                yield "email", start + (start > 0 and text[start - 1 : start + 1] in _ESCAPED), right.end()


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _EN_AT.finditer(text):
        if _joined(text, m.start()):
            continue
        # Up to four capitalised words: to the first that ends a street's name, else all of them.
        at, end, n, known = m.end(), 0, 0, False
        while n < 4 and not known and (w := _EN_WORD.match(text, at)):
            n, end, known = n + 1, w.end(), w[0] in _TYPE and n > 0
            if text[end : end + 1] != " ":
                break
            at = end + 1
        if not n:
            continue
        if known and text[end : end + 1] == "." and (w[0] in _SHORT or (w[0] == "Rd" and text[end + 1 : end + 2] in (",", "."))):
            end += 1
        flat = _FLAT_AFTER.match(text, end)
        end = flat.end() if flat else end
        town = _TOWN_AFTER.match(text, end)
        if town:
            end = town.end()
        elif not known:
            continue
        base = max(0, m.start() - 24)
        flat = _FLAT_BEFORE.search(text[base : m.start()])
        if known or town[0] or flat or n > 1:
            yield "street_address", base + flat.start() if flat else m.start(), end
    for m in _DE_AT.finditer(text):
        i = m.start() + 1
        lower = text[max(0, i - 12) : i].lower()
        if lower.endswith(_DE_ENDS):
            base = max(0, i - STREET)
            name = _DE_NAME.search(text[base:i])
            hit = _DE.match(text, i)
            if name and hit:
                yield "street_address", base + name.start(), hit.end()
    for m in _ES_AT.finditer(text):
        hit = _ES.match(text, m.end())
        if hit and not _joined(text, m.start()):
            yield "street_address", m.start(), hit.end()
    for m in _FR.finditer(text):
        if not _joined(text, m.start()):
            yield "street_address", m.start(), m.end()
    if "号" in text:
        for m in _ZH.finditer(text):
            yield "street_address", m.start(), m.end()


def _names(text: str) -> Iterator[tuple[str, int, int]]:
    """Every run of two to four capitalised words or initials, family name first with a comma, and what follows a title."""
    tokens = [m.span() for m in _NAME_TOKEN.finditer(text)]
    last = len(tokens) - 1
    for i, (a, b) in enumerate(tokens):
        near = i < last and tokens[i + 1][0] - b <= 8
        titled = text[a - 1 : a] == " " and text[a - 2 : a - 1] in _TITLE_LAST and _TITLE_END.search(text[max(0, a - 12) : a])
        if not (near or titled) or _joined(text, a):
            continue
        if titled and b - a > 2 and text[b : b + 1] != "@" and not text[b : b + 1].isalnum():
            yield "person_name", a, b
        j, words = i, 0 if text[b - 1] == "." else 1
        while j < last and j - i < 3:
            gap = text[tokens[j][1] : tokens[j + 1][0]]
            if gap != " " and gap not in _LINKS and not (gap == "" and text[tokens[j][1] - 1] == "."):
                if gap == ", " and words and tokens[j][1] - tokens[j][0] > 2:  # family name, given name
                    end = tokens[j + 1][1]
                    if text[end - 1] != "." and text[end : end + 1] != "@" and not text[end : end + 1].isalnum():
                        yield "person_name", a, end
                        if j + 1 < last and text[end : tokens[j + 2][0]] == " ":
                            third = tokens[j + 2][1]
                            if not text[third : third + 1].isalnum() and text[third : third + 1] != "@":
                                yield "person_name", a, third
                break
            j += 1
            x, y = tokens[j]
            if text[y - 1] == ".":
                continue
            words += 1
            if text[y : y + 1] != "@" and not text[y : y + 1].isalnum() and text[y : y + 1] != "_":
                yield "person_name", a, y


_TITLE_LAST = frozenset("rsafeunyñ.")


def _chinese_names(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _ZH_NAME.finditer(text):
        a = m.start()
        before = text[max(0, a - 4) : a].endswith(_ZH_BEFORE)
        for b in range(a + 2, m.end() + 1):
            if before or text.startswith(_ZH_AFTER, b):
                yield "person_name", a, b


def _spans(text: str) -> list[tuple[str, int, int]]:
    """Proposed (kind, start, end)."""
    out = list(_emails(text)) if "@" in text or "at" in text or "AT" in text or "arroba" in text else []
    for m in _PHONE.finditer(text):
        a, b = m.span()
        if b - a >= 8 and sum(map(str.isdigit, m[0])) >= 7 and not _joined(text, a):
            out.append(("phone", a, b))
    seen = set()
    for pattern in (_ID, _MIXED):
        for m in pattern.finditer(text):
            a, b = m.span()
            if b - a >= 7 and 4 + 2 * (pattern is _ID) <= sum(map(str.isdigit, m[0])) <= 18 and (a, b) not in seen and not _joined(text, a):
                seen.add((a, b))
                out.append(("id_number", a, b))
    out += _addresses(text)
    out += dict.fromkeys(_names(text))
    if not text.isascii():
        out += _chinese_names(text)
    return out


_NUMBERED = re.compile(r"[\s,;(:]*(?:on )?[+(]?\d")
_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|(?:19|20)\d{6}(?!\d)")
_DIGITS, _ALPHA = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")
_SHAPES = {(3, 2, 4): 1, (2, 3, 3, 3): 2, (3, 3, 4): 3, (1, 3, 3, 4): 3, (8,): 4, (9,): 5, (2, 2, 2): 6, (3, 3, 3): 7, (3, 4, 4): 8, (7,): 9, (10,): 10, (11,): 11, (18,): 12}


def _context(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    left = _TOK.findall(text[max(0, a - 48) : a].replace("\\n", ". "))[-5:]
    right = _TOK.findall(text[b : b + 32])[:3]
    return left, right


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a proposal; the same list for every kind."""
    s = text[a:b]
    left, right = _context(text, a, b)
    low = [w.lower() for w in left]
    near, wide = set(low[-2:]), set(low)
    follow = {w.lower() for w in right[:2]}
    groups = tuple(map(len, _DIGITS.findall(s)))
    digits = sum(groups)
    words = _ALPHA.findall(s)
    lows = [w.lower() for w in words]
    letters = sum(map(len, words))
    first, last = (lows[0], lows[-1]) if lows else ("", "")
    before, after = text[a - 1 : a], text[b : b + 1]
    starts = not left or left[-1] in ".:;" or before in '\n"'
    out = [
        digits, letters, len(s), len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0, _SHAPES.get(groups, 0),
        s.startswith("+"), s.startswith("00"), s.startswith("0"), s.startswith("("), "(" in s, "." in s, "-" in s, " " in s, "," in s,
        s[:1].isalpha(), s[-1:].isalpha(), len(words), len(words[0]) if words else 0, len(words[-1]) if words else 0, s.isupper(), not s.isascii(),
        first in _COMMON, last in _COMMON, any(w in _COMMON for w in lows), first in _GIVEN, last in _GIVEN, starts,
        any(w in _TYPE for w in words), bool(words) and words[-1] in _TYPE, s.lower().endswith(_DE_ENDS), "'" in s or "’" in s,
        "@" in s, bool(_DATE.match(s)), after in ("T", ":") or before == ":", before == "@", before == "(", after == ")",
    ]
    for c in _CUE.values():
        out += [bool(near & c), bool(wide & c), bool(low and low[-1] in c), bool(follow & c), first in c]
    around = [w for w in (*left, *right) if len(w) > 1 and w.isalpha()]
    behind = text[b : b + 48]
    touching = before == " " and bool(left) and left[-1][:1].isupper()
    out += [sum(map(str.isupper, around)) / max(1, len(around)), "@" in behind or "(at)" in behind or "[at]" in behind, bool(_NUMBERED.match(behind)), bool(left) and left[-1] == ":", bool(left) and left[-1] == ".", bool(left) and left[-1] == ","]
    out += [touching and left[-1].lower() not in _COMMON, touching, bool(left) and left[-1].isdigit(), bool(right) and right[0][:1].islower() and after == " ", bool(right) and right[0][:1].isupper() and after == " ", bool(right) and right[0] in ".,)", after == "'", bool(right and right[0] == "(")]
    return [float(v) for v in out]


def _person(rng: random.Random, made) -> str | tuple[str, str]:
    """A made-up name in one of its usual forms; with a title as (title, name)."""
    first = rng.choice(_NAMES) if rng.random() < 0.7 else made(2).capitalize()
    stem = made(rng.randint(1, 3)).capitalize()
    family = rng.choice([stem + rng.choice(["", "son", "man", "ez", "er", "ov", "ini", "ley", "ton", "berg", "ski", "mont", "hurst", "sen", "ova", "wright", "eck", "dal"])] * 5 + ["O'" + stem, "Mc" + stem, "D'" + stem, f"{stem}-{made(2).capitalize()}", f"van {stem}", f"de la {stem}", f"{stem} {made(2).capitalize()}"])
    if rng.random() < 0.25:
        family = family.translate(str.maketrans("aeoucs", "áéöüčš"))
    if rng.random() < 0.1:
        first = f"{first}-{rng.choice(_NAMES)}"
    plain = family if " " not in family else stem
    return rng.choice(
        [f"{first} {family}"] * 8
        + [f"{first} {family}".upper(), f"{plain}, {first}", f"{plain}, {first}".upper(), f"{first[0]}. {plain}", f"{first} {rng.choice('ABCDEFGHJKLMPRSTW')}. {plain}", f"{plain}, {first}"]
        + [(rng.choice(_TITLES), plain), (rng.choice(_TITLES), plain.upper()), (rng.choice(_TITLES), f"{first} {family}")]
    )


_TITLES = ("Mr. ", "Mrs ", "Ms. ", "Dr. ", "Prof. ", "Mr ", "Herr ", "Frau ", "Sra. ", "Mme ")
_NAMES = tuple(w.capitalize() for w in sorted(_GIVEN) if w.isalpha() and len(w) > 2)


def _forms(rng: random.Random, made) -> dict[str, list]:
    """A mention of each kind in one of its usual notations, all invented."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letter = lambda k=1: "".join(rng.choice("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(k))
    phone = [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"00{rng.choice(['49', '44', '34', '33', '39'])}-{d(2)}-{d(8)}", f"+49 {d(2)} {d(5)} {d(3)}",
             f"+1{d(10)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"0{d(3)}/{d(7)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} {d(3)} {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+49 (0){d(2)} {d(6)}", f"0{d(3)} {d(4)} {d(3)}", f"+44 20 {d(4)} {d(4)}", f"1{d(2)} {d(4)} {d(4)}"]
    ident = [f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{letter(2)} {d(2)} {d(2)} {d(2)} {letter()}", f"{d(8)}-{letter()}", f"{d(8)}{letter()}", f"{letter()}{d(8)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(9), f"{letter()}{d(7)}", f"{letter()}{d(7)}{letter()}", f"{letter(1)}{d(2)}{letter(1)}{d(2)}{letter(1)}{d(2)}", f"{letter(2)}{d(6)}{letter()}", f"{d(11)}", f"{d(17)}X"]
    name = made(2).capitalize()
    town = f", {rng.choice(['', d(5) + ' '])}{made(3).capitalize()}"
    english = f"{rng.randint(1, 300)}{rng.choice(['', '', '', 'B'])} {rng.choice([name, name, name + ' ' + made(2).capitalize()])} {rng.choice(['Street', 'Road', 'Avenue', 'Lane', 'Drive', 'Court', 'St.', 'Ave.', 'Ct.', 'Rd', rng.choice(_TYPES), rng.choice(_TYPES)])}"
    if rng.random() < 0.3:
        english = rng.choice([f"Flat {rng.randint(1, 40)}, {english}", f"{english}, Apt {rng.randint(1, 40)}"])
    german = f"{rng.choice([name + rng.choice(_DE_ENDS[:12]), name + rng.choice(_DE_ENDS[:12]), name + 'er Straße', 'Alte ' + made(2).capitalize() + 'gasse'])} {rng.randint(1, 200)}{rng.choice(['', '', 'a'])}"
    roman = rng.choice([f"{rng.choice(_HEADS)} {rng.choice(['de la ', 'del ', 'de los ', ''])}{name} {rng.randint(1, 250)}", f"{rng.randint(1, 99)} {rng.choice(['rue', 'Rue', 'avenue', 'quai'])} {rng.choice(['de la ', 'du ', ''])}{name}"])
    street = rng.choice([english, english, german, roman]) + (town if rng.random() < 0.4 else "")
    if rng.random() < 0.06:
        street = f"{rng.choice(['北京市', '上海市', '', '杭州市'])}{rng.choice(['长安', '南京', '人民', '解放'])}{rng.choice(['路', '街', '大道'])}{rng.randint(1, 300)}号"
    first, family = rng.choice(_NAMES), made(2)
    domain = f"{made(2)}.{rng.choice(['com', 'org', 'net', 'example', 'io', 'de', 'test', 'co.uk', 'fr'])}"
    user = rng.choice([f"{first}.{family}".lower(), f"{first[0]}{family}".lower(), made(2) + d(2), f"{first}-{family}+tag".lower(), f"{first}_{family}".upper(), made(2)])
    email = [f"{user}@{domain}", f"{user}@mail.{domain}", f"{user} (at) {domain}", f"{user} [at] " + domain.replace(".", " [dot] "), f"{user} at " + domain.replace(".", " dot "), f"{user}@{domain}", f"{user} (at) " + domain.replace(".", " (dot) ")]
    return {"phone": phone, "id_number": ident, "street_address": [street], "email": email}


# Made-up sentences with mentions: {n} a person, {p} a phone number, {i} an identity number with what announces it, {a} an address, {e} an email address, {w} a word.
_CARRIERS = (
    "{n} asked whether the {w} could wait.", "Good morning {n}, the {w} is ready.", "Ich habe {n} gestern getroffen.", "Según {n}, el {w} llega tarde.", "D'après {n}, tout va bien.", "Speaker: {n}", "Yours truly, {n}", "The chair thanked {n} and {n} for the {w}.",
    "{n} ({p}) runs the {w} shop.", "{n}, {p}", "{n} <{e}>", "{n}, {i}, resides at {a}.", "Applicant {n}, {i}, {a}.", "Name: {n}\nPhone: {p}\nMail: {e}", "Name: {n}; Address: {a}; {i}", "Guest list: {n}, {n}, {n}.", "A letter by {n} mentions the {w}.", "Ask {n} or {n} about {w}.",
    "Her {i} was misread.", "My {i}.", "Please verify {i} before Friday.", "{i} is on file.", "Form 7 needs the {i}, the {w} follows.", "Seine {i} fehlt noch.", "You may text {p} after six.", "Fax to {p}.", "Telefon: {p}", "Tel. {p}, {w}", "Old number {p}, new number {p}.", "Mi teléfono es {p}.", "{p} is the {w} line.", "Ring {p}!",
    "Our shop at {a} closes early.", "He lived at {a} for years.", "Wir wohnen in der {a}.", "Anschrift: {a}", "Vivo en {a}.", "Deliveries go to {a}.", "Turn left to reach {a}.", "The flat in {a} is for rent, call {p}.", "Send the {w} to {a} or mail {e}.", "{a} was sold.",
    "Questions? {e}", "Write an email to {e} today.", "Escríbeme a {e}.", "Schreib an {e}, nicht an {e}.", "{e} bounced twice.", "From: {e}\nTo: {e}", "Add {e} to the {w} list.", "According to the lease, {n} pays the {w}.", "{n} moved from {a} to {a}.", "{n} stays at {a} now.", "{n} rents a room at {a}.", "May {n} join? The {w} is set.", "Would {n} like the {w}?", "Did {n} and {n} agree?", "The {w} of {n} was late.", "{n}'s {w} is new.", "Hired: {n}; fired: {n}.", "Dinner with {n} was fine; the {w} was cold.", "Heute kam {n} mit dem {w} vorbei.", "Patient {n} called from {p}.", "{n} said so, {n} denied it.", "Spoke to {n} re {w}.", "By {n}, {w} editor.", "联系人：{z}，电话{p}。", "请把文件交给{z}先生。", "{z}女士的地址是{a}。",
)
# Made-up sentences without any mention: {t} a title of two or three capitalised words, {w} a word, {c} a capitalised one, {d3} three digits and so on.
_PLAIN = (
    "The {t} opened on Monday.", "Our {t} starts next week.", "Section {d1}, {t}, was rewritten.", "Part {d2} {t} explains it.", "A {t} is not a {w}.", "We watched {t} at the cinema.", "{t} is a brand of {w}.", "In {c} {c} it rains.", "Every {c} {c} has a {w}.", "The {c} of {c} was late.",
    "Flight {d4} leaves at {d2}:{d2}.", "Tracking {d4}-{d4}-{d3} says delivered.", "Part number {d3}-{d2}-{d2} is out of stock.", "The log {d8}-{d4} is empty.", "Sample {d3}-{d5} and {d4}-{d3} failed.", "ISBN 978-{d1}-{d2}-{d6}-{d1}.", "Pi is 3.{d8}.", "Row {d7} of {d6}.", "Epoch {d10} or {d13}.", "Coordinates {d2}.{d6}, {d2}.{d6}.",
    "Server 10.{d2}.{d3}.{d1} replied in {d4} ms.", "Balance {d3},{d3}.{d2} euros.", "Between 19{d2} and 20{d2} we sold {d6}.", "On 20{d2}-0{d1}-1{d1} at 1{d1}:{d2}:{d2}.", "Hash a{d4}bc{d3}ef.", "Use @{w} in the chat.", "Type {w}@ and press tab.", "Two {w}@{d1} euros.", "Meet at noon dot.", "Look at {w} {w}.",
    "{c}, {c} and {c} are colours.", "Dear All, {w} again.", "Meter {d9} of {c} reads {d5}.", "Device id {d3}-{d5} is online.", "Request id {d6}-{d3} timed out.", "Record ID {d4}-{d4}: {w}.", "In {c}, {c} is closed.", "Until {c}, {c} under {w}.", "{c}, {c} and the {w}.", "After {c}, {c} {w} again.", "Score {d1}-{d1} after {d2} minutes.", "Licence plate {d3}-{d3}-{d4}.", "Item {d4} {c} {w}.", "{d3} {c} {w} cost little.", "{d2} {c} {c} were lost.", "Edition {d1}.{d2} of {c} {c}.", "Der {c} am {c} ist neu.", "La {c} de {c} está cerca.",
    "{c} {c} {w} the {w}.", "{c} {c} {d3} {w} {w}.", "{c} my {w}, please.", "{c} or {w}, whichever is nearer.", "Near {c} {c} a {w} opened.", "Room {d3} {c} {c} is empty.", "Locker {d5}-{d4}: {w}.", "Code {d3} {d2} {d2}.", "{w}: {c} {c} {w}, {w}.", "Invoice total {d6} for {d10}.", "Key {d8} of {c}.", "Budget {d6} {d3}.", "{c} {c}: {w}.", "项目{w}已经完成，第{d2}次。", "今天的天气很好。", "周末我们去公园。",
)
_ANNOUNCED = ("SSN", "social security number", "social", "passport", "passport no.", "Passport number:", "tax id", "tax number", "Steuer-ID", "DNI", "NIE", "national id", "NI number", "national insurance no.", "ID card", "identity card number", "Ausweis", "driving licence")
_GENERAL = "water garden window table silver golden market station river summer winter music paper engine signal harbour castle forest valley kitchen library museum theatre energy climate weather history science nature culture design quality safety travel finance support network digital global central royal public open smart bright quiet rapid modern ancient".split()


def training_text(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """One made-up passage and its mentions."""
    syl = "ba be bo ca da de du el fa fe ga go ha hel im ja ka kel la lin lo ma mi mo na nor o pa pe qui ra ri ro sa sel si ta tel to u va vel wen xi ya zo".split()
    made = lambda k: "".join(rng.choice(syl) for _ in range(k))
    word = lambda: rng.choice(_GENERAL) if rng.random() < 0.5 else made(rng.randint(2, 4))
    kinds = {"{n}": "person_name", "{p}": "phone", "{i}": "id_number", "{a}": "street_address", "{e}": "email", "{z}": "person_name"}
    text, spans = "", []
    count = rng.choice([1, 1, 2, 3])
    for n in range(count):
        frame = rng.choice(_CARRIERS) if rng.random() < 0.62 else rng.choice(_PLAIN)
        forms = _forms(rng, made)
        for piece in re.split(r"(\{\w+\})", frame):
            if piece in kinds:
                if piece == "{n}":
                    form = _person(rng, made)
                elif piece == "{z}":
                    form = rng.choice(_SURNAMES) + "".join(rng.choice("伟芳娜敏静强磊军洋勇艳杰娟涛明超") for _ in range(rng.randint(1, 2)))
                else:
                    form = rng.choice(forms[kinds[piece]])
                if piece == "{i}":
                    text += rng.choice(_ANNOUNCED) + " "
                if isinstance(form, tuple):
                    text += form[0]
                    form = form[1]
                spans.append((kinds[piece], len(text), len(text) + len(form)))
                text += form
            elif piece.startswith("{d"):
                text += "".join(rng.choice("0123456789") for _ in range(int(piece[2:-1])))
            elif piece == "{t}":
                text += " ".join(word().capitalize() for _ in range(rng.randint(2, 3)))
            elif piece == "{c}":
                text += word().capitalize()
            elif piece == "{w}":
                text += word()
            else:
                text += piece
        text += rng.choice([" ", " ", "\n", "\\n"]) if n + 1 < count else ""
    if not spans and rng.random() < 0.15 and len(text.upper()) == len(text):  # shouted as a whole
        return text.upper(), spans
    return text, spans


@dataclass
class Detector:
    models: dict[str, Trees]
    thresholds: dict[str, float]

    def find(self, texts: list[str]) -> list[tuple[int, str, int, int]]:
        """(text number, kind, start, end) of the selected spans, sorted."""
        owner, spans = [], []
        by_kind: dict[str, list[int]] = {k: [] for k in KINDS}
        rows: dict[str, list] = {k: [] for k in KINDS}
        for i, t in enumerate(texts):
            if not t:
                continue
            for kind, a, b in _spans(t):
                by_kind[kind].append(len(spans))
                rows[kind].append(features(t, kind, a, b))
                owner.append(i)
                spans.append((kind, a, b))
        margin = np.zeros(len(spans))
        for kind, at in by_kind.items():
            if at:
                margin[at] = self.models[kind].probability(np.array(rows[kind])) - self.thresholds[kind]
        taken: dict[int, list[tuple[int, int]]] = {}
        out = []
        chosen = [j for j in range(len(spans)) if margin[j] > 0]
        # An email or address holds what looks like a name or number, never the other way round.
        rank = {"email": 0, "street_address": 1, "person_name": 2, "phone": 2, "id_number": 2}
        for j in sorted(chosen, key=lambda j: (rank[spans[j][0]], -round(margin[j], 2), spans[j][1] - spans[j][2], spans[j])):
            kind, a, b = spans[j]
            own = taken.setdefault(owner[j], [])
            if all(b <= x or a >= y for x, y in own):
                own.append((a, b))
                out.append((owner[j], kind, a, b))
        return sorted(out, key=lambda x: (x[0], x[2]))


def train(sample: int = SAMPLE, seed: int = SEED) -> Detector:
    """The detector from ``sample`` invented sentences: two thirds fit the trees, the rest calibrates the thresholds."""
    rng = random.Random(seed)
    x: dict[str, list] = {k: [] for k in KINDS}
    y: dict[str, list] = {k: [] for k in KINDS}
    for _ in range(sample):
        text, spans = training_text(rng)
        true = set(spans)
        for kind, a, b in _spans(text):
            x[kind].append(features(text, kind, a, b))
            y[kind].append(float((kind, a, b) in true))
    models, thresholds = {}, {}
    for kind in KINDS:
        xs, ys = np.array(x[kind]), np.array(y[kind])
        held = np.arange(len(ys)) % 3 == 2
        models[kind] = fit_trees(xs[~held], ys[~held])
        thresholds[kind] = best_threshold(models[kind].probability(xs[held]), ys[held])
    return Detector(models, thresholds)


def mentions(df: DataFrame, keys: list[str], text: str, detector: Detector) -> DataFrame:
    """keys, kind, start_pos, end_pos of every mention in the texts of df."""
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(detector))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", kind string, start_pos int, end_pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = cloudpickle.loads(shared.value)
        for batch in batches:
            rows = found.find(batch.column("__text").to_pylist())
            c = list(zip(*rows, strict=True)) if rows else [()] * 4
            take = pa.array(c[0], pa.int32())
            arrays = [batch.column(k).take(take) for k in keys] + [pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "kind", "start_pos", "end_pos"])

    return df.filter(F.length(F.col(text)) > 0).select(*keys, F.col(text).alias("__text")).mapInArrow(run, out)


def redacted(df: DataFrame, keys: list[str], text: str, detector: Detector) -> DataFrame:
    """keys, text with each mention replaced by its kind in angle brackets, e.g. <EMAIL>; null texts stay null."""
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(detector))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", redacted string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = cloudpickle.loads(shared.value)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for i, kind, a, b in reversed(found.find(texts)):
                texts[i] = f"{texts[i][:a]}<{kind.upper()}>{texts[i][b:]}"
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], names=[*keys, "redacted"])

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, out)
