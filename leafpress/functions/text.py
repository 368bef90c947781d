"""Text, search-query and option functions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import FALSE_TEXTS

#: White space as browsers have it.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def clean_attribute(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(\n+{SPACE}*)+", "\n")


def published(parsed: Column, metadata: Column, last_modified: Column) -> Column:
    """When a page was published: as its main content says, else its metadata, else its header; empty texts say nothing."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(some(parsed), some(F.try_element_at(F.try_element_at(metadata, F.lit("article:published_time")), F.lit(1))), some(last_modified))


def final_tidy(markdown: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(markdown, f"^{SPACE}+|{SPACE}+$", ""), r"\n{3,}", "\n\n")


def tidy_markdown(markdown: Column | str) -> Column:
    """Links and pictures that are broken over lines or padded stand on one line, blank lines are squeezed to one, indents and
    outer white space go. What doesn't close as a link stays."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: tidied(x) if x is not None else None)

    return F.pandas_udf(run, T.StringType())(markdown)


def tidied(text: str) -> str:
    lines = [line.lstrip(" \t") for line in _links_joined(text).split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def _links_joined(text: str) -> str:
    """One scan: brackets are matched on a stack, and a closed one that an address in parentheses follows is written anew."""
    parts: list[list[str]] = [[]]
    i = 0
    while i < len(text):
        c = text[i]
        if c == "[":
            parts.append([])
        elif c == "]" and len(parts) > 1:
            label = "".join(parts.pop())
            opened = i + 1
            while opened < len(text) and text[opened].isspace():
                opened += 1
            end = text.find(")", opened) if text[opened : opened + 1] == "(" else -1
            address = text[opened + 1 : end].strip() if end > 0 else ""
            if address and len(address.split()) == 1:
                parts[-1].append(f"[{' '.join(label.split())}]({address})")
                i = end
            else:
                parts[-1].append(f"[{label}]")
        else:
            parts[-1].append(c)
        i += 1
    while len(parts) > 1:
        rest = "".join(parts.pop())
        parts[-1].append("[" + rest)
    return "".join(parts[0])


def pseudo_boolean(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(False)).otherwise(~F.lower(F.trim(text)).isin(*FALSE_TEXTS))


def escape_citation(text: Column) -> Column:
    return F.translate(text, "\u3010\u3011\u25fc\u2020\u200b", "\u3016\u3017\u25fe\u2021")


def caption(text: Column) -> Column:
    """A caption without line feeds, outer quotes and final full stop."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"^[\"']+|[\"']+$", ""), r"\.$", "")


#: Alternative texts that say nothing.
USELESS_ALTS = ("image", "img", "photo", "picture", "pic", "alt", "figure", "thumbnail", "icon")


def useful_alt(alt: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(alt)).isin("", *USELESS_ALTS), F.lit(False))


def small_image(width: Column, height: Column) -> Column:
    """What to say of a picture too small to describe; null for others and for unknown sizes."""
    least = F.least(width, height)
    return F.when(least <= 1, F.lit("A tracking pixel")).when(least < 64, F.lit("A small image"))


def fit_box(width: Column, height: Column, max_width: int = 1024, max_height: int = 1024) -> Column:
    """Size inside a box, at the same ratio, never larger; halves round up."""
    ratio = F.least(F.lit(1.0), F.lit(float(max_width)) / width, F.lit(float(max_height)) / height)
    round_half_up = lambda x: F.floor(x + 0.5).cast("int")
    return F.struct(round_half_up(width * ratio).alias("width"), round_half_up(height * ratio).alias("height"))


def search_query(q: Column) -> Column:
    """query, sites, no_sites: words with a site: or -site: operator taken out."""
    words = F.split(F.trim(q), r"\s+")
    sites = lambda op: F.transform(F.filter(words, lambda w: F.lower(w).rlike(f"^{op}:.+")), lambda w: F.lower(F.regexp_replace(w, "^[^:]*:", "")))
    rest = F.filter(words, lambda w: ~F.lower(w).rlike("^-?site:.+"))
    return F.struct(F.array_join(rest, " ").alias("query"), sites("site").alias("sites"), sites("-site").alias("no_sites"))


def with_operators(q: Column, operators: dict[str, list[str]]) -> Column:
    """q and its explicit operators: OR inside one, AND across."""
    groups = [" OR ".join(f"{k}:{v}" for v in values) for k, values in operators.items() if values]
    if not groups:
        return q
    return F.concat(q, F.lit(" " + (f"({groups[0]})" if len(groups) == 1 and " OR " in groups[0] else groups[0] if len(groups) == 1 else " AND ".join(f"({g})" for g in groups))))


#: A letter of a script that is written from right to left.
_RTL = r"[\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}]"


def fallback_queries(q: Column) -> Column:
    """Shorter and shorter forms to try: a quarter of the words fewer each time from the end (from the start for right-to-left
    scripts), at last two words."""
    words = F.split(F.trim(q), r"\s+")
    n, rtl = F.size(words), q.rlike(_RTL)
    step = F.ceil(n / 4).cast("int")
    tries = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.array_join(F.when(rtl, F.slice(words, step * i + 1, F.greatest(n - step * i, F.lit(0)))).otherwise(F.slice(words, F.lit(1), F.greatest(n - step * i, F.lit(0)))), " "))
    last = F.array_join(F.when(rtl, F.slice(words, F.greatest(n - 1, F.lit(1)), F.lit(2))).otherwise(F.slice(words, F.lit(1), F.lit(2))), " ")
    return F.array_distinct(F.filter(F.concat(tries, F.array(last)), lambda x: (x != "") & (x != F.trim(q))))


#: ISO 639-1 and ISO 639-3 codes.
LANGUAGES = {
    "aa": "aar", "ab": "abk", "ae": "ave", "af": "afr", "ak": "aka", "am": "amh", "an": "arg", "ar": "ara", "as": "asm",
    "av": "ava", "ay": "aym", "az": "aze", "ba": "bak", "be": "bel", "bg": "bul", "bi": "bis", "bm": "bam", "bn": "ben",
    "bo": "bod", "br": "bre", "bs": "bos", "ca": "cat", "ce": "che", "ch": "cha", "co": "cos", "cr": "cre", "cs": "ces",
    "cu": "chu", "cv": "chv", "cy": "cym", "da": "dan", "de": "deu", "dv": "div", "dz": "dzo", "ee": "ewe", "el": "ell",
    "en": "eng", "eo": "epo", "es": "spa", "et": "est", "eu": "eus", "fa": "fas", "ff": "ful", "fi": "fin", "fj": "fij",
    "fo": "fao", "fr": "fra", "fy": "fry", "ga": "gle", "gd": "gla", "gl": "glg", "gn": "grn", "gu": "guj", "gv": "glv",
    "ha": "hau", "he": "heb", "hi": "hin", "ho": "hmo", "hr": "hrv", "ht": "hat", "hu": "hun", "hy": "hye", "hz": "her",
    "ia": "ina", "id": "ind", "ie": "ile", "ig": "ibo", "ii": "iii", "ik": "ipk", "io": "ido", "is": "isl", "it": "ita",
    "iu": "iku", "ja": "jpn", "jv": "jav", "ka": "kat", "kg": "kon", "ki": "kik", "kj": "kua", "kk": "kaz", "kl": "kal",
    "km": "khm", "kn": "kan", "ko": "kor", "kr": "kau", "ks": "kas", "ku": "kur", "kv": "kom", "kw": "cor", "ky": "kir",
    "la": "lat", "lb": "ltz", "lg": "lug", "li": "lim", "ln": "lin", "lo": "lao", "lt": "lit", "lu": "lub", "lv": "lav",
    "mg": "mlg", "mh": "mah", "mi": "mri", "mk": "mkd", "ml": "mal", "mn": "mon", "mr": "mar", "ms": "msa", "mt": "mlt",
    "my": "mya", "na": "nau", "nb": "nob", "nd": "nde", "ne": "nep", "ng": "ndo", "nl": "nld", "nn": "nno", "no": "nor",
    "nr": "nbl", "nv": "nav", "ny": "nya", "oc": "oci", "oj": "oji", "om": "orm", "or": "ori", "os": "oss", "pa": "pan",
    "pi": "pli", "pl": "pol", "ps": "pus", "pt": "por", "qu": "que", "rm": "roh", "rn": "run", "ro": "ron", "ru": "rus",
    "rw": "kin", "sa": "san", "sc": "srd", "sd": "snd", "se": "sme", "sg": "sag", "si": "sin", "sk": "slk", "sl": "slv",
    "sm": "smo", "sn": "sna", "so": "som", "sq": "sqi", "sr": "srp", "ss": "ssw", "st": "sot", "su": "sun", "sv": "swe",
    "sw": "swa", "ta": "tam", "te": "tel", "tg": "tgk", "th": "tha", "ti": "tir", "tk": "tuk", "tl": "tgl", "tn": "tsn",
    "to": "ton", "tr": "tur", "ts": "tso", "tt": "tat", "tw": "twi", "ty": "tah", "ug": "uig", "uk": "ukr", "ur": "urd",
    "uz": "uzb", "ve": "ven", "vi": "vie", "vo": "vol", "wa": "wln", "wo": "wol", "xh": "xho", "yi": "yid", "yo": "yor",
    "za": "zha", "zh": "zho", "zu": "zul",
}


def iso639_3(tag: Column) -> Column:
    """The language of a tag, by what stands before its first hyphen; und if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^([A-Za-z]{2})(?:[-_]|$)", 1))), F.lit("und"))


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmss with an offset, as a timestamp without zone in UTC; null if it isn't one."""
    bare = F.regexp_replace(F.substr(text, F.lit(3)), "'", "")
    stamp = F.try_to_timestamp(F.substring(bare, 1, 14), F.lit("yyyyMMddHHmmss"))
    sign = F.when(F.substring(bare, 15, 1) == "-", F.lit(1)).otherwise(F.lit(-1))
    minutes = F.coalesce(F.substring(bare, 16, 2).try_cast("int") * 60 + F.coalesce(F.substring(bare, 18, 2).try_cast("int"), F.lit(0)), F.lit(0))
    return F.when(F.length(bare) >= 14, stamp + F.make_dt_interval(mins=sign * minutes))


def token_estimate(text: Column) -> Column:
    """An estimate where no tokenizer is configured: one token for four bytes, rounded up. Not a tokenizer's count."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def token_counter(path: str, text: Column | str) -> Column:
    """Exact counts by a tokenizer file (JSON of the tokenizers library)."""

    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return texts.map(lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids) if x is not None else 0)

    return F.pandas_udf(run, T.LongType())(text)


def token_trim(path: str, text: Column | str, limit: int) -> Column:
    """The text of the first limit tokens, without a cut-off character at its end."""

    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def of(x: str | None) -> str | None:
            if x is None:
                return None
            ids = tokenizer.encode(x, add_special_tokens=False).ids
            return x if len(ids) <= limit else tokenizer.decode(ids[:limit], skip_special_tokens=False).rstrip("\ufffd")

        return texts.map(of)

    return F.pandas_udf(run, T.StringType())(text)
