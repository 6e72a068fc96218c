"""License scans: ordered signature rules behind a keyword prefilter, all of it Spark columns.

A text is first searched for the few keywords without which no rule can match; most texts end there. The others are
brought into canonical form: A-Z lower-cased, words (runs of ASCII digits, letters and non-ASCII characters) joined by
one space. Each rule is a regular expression over that form with a keyword of its own, a priority and a weight; it runs
only where its keyword occurs. Every match is an interval of words. An interval that lies inside a longer one, or equals
one of a better priority, is suppressed, so that "gpl 3 0 only" in an SPDX line doesn't also count as "gpl". The labels
left are joined by those of the base phrases, which stay whatever contains them.

Defined cases: a null or empty text has no words, no labels and a score of 0; repeated rows get equal results; other
columns are ignored; whole texts are read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Phrases whose places are counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches whole words of the canonical form; the lower ``priority`` wins between equal intervals."""

    label: str
    priority: int
    weight: float
    keyword: str
    pattern: str


# Signatures by family: label, keyword, then patterns over canonical words from the most to the least telling. A prefix
# marks the kind: "=" a full name or grant (weight 0.95), "~" a short or indirect mention (weight 0.6).
_SIGNATURES = r"""
mit|mit|=licensed under the (?:terms of the )?mit licen[sc]e|=released under the (?:terms of the )?mit licen[sc]e|=distributed under the (?:terms of the )?mit licen[sc]e|=the mit licen[sc]e(?: mit)?|=mit licen[sc]ed?|~opensource org licenses mit(?: license)?(?: php)?|~mit style licen[sc]e|~mit x11 licen[sc]e
mit|permission|=permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit-0|attribution|=mit no attribution(?: license)?
mit-0|mit|=mit 0 licen[sc]e
expat|expat|=expat licen[sc]e|~expat style licen[sc]e
x11|x11|=x11 licen[sc]e|~x11 style licen[sc]e
apache-2.0|apache|=licensed under the apache licen[sc]e(?: version)? 2(?: 0)?|=apache licen[sc]e(?: version)? 2(?: 0)?|=apache software licen[sc]e(?: version)? 2(?: 0)?|=apache 2(?: 0)? licen[sc]ed?|=www apache org licenses license 2 0(?: txt| html)?|~apache 2 0
apache-2.0|asl|~asl 2 0
apache-1.1|apache|=apache (?:software )?licen[sc]e(?: version)? 1 1
apache-1.0|apache|=apache (?:software )?licen[sc]e(?: version)? 1(?: 0)
apache|apache|~apache (?:software )?licen[sc]ed?|~the apache software foundation
gpl-3.0|general|=gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?|=gnu general public licen[sc]e v3(?: 0)?|=general public licen[sc]e version 3(?: of the license)?
gpl-3.0-or-later|general|=gnu general public licen[sc]e(?: as published by the free software foundation)? either version 3 of the license or at your option any later version
gpl-2.0|general|=gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?|=gnu general public licen[sc]e v2(?: 0)?|=general public licen[sc]e version 2(?: of the license)?
gpl-2.0-or-later|general|=gnu general public licen[sc]e(?: as published by the free software foundation)? either version 2 of the license or at your option any later version
gpl-1.0|general|=gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 1(?: 0)?
gpl|general|~gnu general public licen[sc]e|~under the terms of the gnu general public licen[sc]e
gpl-3.0|gpl|=gpl(?: version)? 3(?: 0)?|=gplv3|=gnu gpl v?3|~www gnu org licenses gpl 3 0(?: html| txt)?
gpl-2.0|gpl|=gpl(?: version)? 2(?: 0)?|=gplv2|=gnu gpl v?2|~www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl|gpl|~gnu gpl|~gpl licen[sc]ed?|~www gnu org licenses gpl(?: html| txt)?
lgpl-3.0|lesser|=gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?|=lesser general public licen[sc]e v3
lgpl-2.1|lesser|=gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 2 1|=lesser general public licen[sc]e v2 1
lgpl|lesser|~gnu lesser general public licen[sc]e|~lesser general public licen[sc]e
lgpl-2.0|library|=gnu library general public licen[sc]e(?: version 2(?: 0)?)?
lgpl-3.0|lgpl|=lgpl(?: version)? 3(?: 0)?|=lgplv3
lgpl-2.1|lgpl|=lgpl(?: version)? 2 1|=lgplv2 1
lgpl|lgpl|~lgpl licen[sc]ed?|~gnu lgpl
agpl-3.0|affero|=gnu affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?|=affero general public licen[sc]e v3
agpl-1.0|affero|=affero general public licen[sc]e version 1(?: 0)?
agpl|affero|~gnu affero general public licen[sc]e|~affero general public licen[sc]e|~affero gpl
agpl-3.0|agpl|=agpl(?: version)? 3(?: 0)?|=agplv3|~gnu agpl
gfdl|documentation|=gnu free documentation licen[sc]e(?: version 1 [1-3])?
gfdl|gfdl|~gfdl(?: 1 [1-3])?
bsd-3-clause|bsd|=3 clause bsd(?: licen[sc]e)?|=bsd 3 clause(?: licen[sc]e)?|=new bsd licen[sc]e|=modified bsd licen[sc]e|=revised bsd licen[sc]e|~opensource org licenses bsd 3 clause
bsd-2-clause|bsd|=2 clause bsd(?: licen[sc]e)?|=bsd 2 clause(?: licen[sc]e)?|=simplified bsd licen[sc]e|=freebsd licen[sc]e|~opensource org licenses bsd 2 clause
bsd-4-clause|bsd|=4 clause bsd(?: licen[sc]e)?|=bsd 4 clause(?: licen[sc]e)?|=original bsd licen[sc]e
0bsd|bsd|=zero clause bsd(?: licen[sc]e)?|=bsd zero clause(?: licen[sc]e)?|=0bsd
bsd|bsd|~licensed under (?:the |a )?bsd licen[sc]e|~bsd licen[sc]ed?|~bsd style licen[sc]e
bsd-3-clause|contributors|=neither the name of (?:the )?(?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd|redistribution|=redistribution and use in source and binary forms with or without modification are permitted
isc|consortium|=internet systems consortium licen[sc]e
isc|isc|=isc licen[sc]e|~opensource org licenses isc
isc|permission|=permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2.0|mozilla|=mozilla public licen[sc]e(?: v| version)? ?2(?: 0)?|=subject to the terms of the mozilla public license v 2 0|~mozilla org mpl 2 0
mpl-1.1|mozilla|=mozilla public licen[sc]e(?: v| version)? ?1 1
mpl-1.0|mozilla|=mozilla public licen[sc]e(?: v| version)? ?1 0
mpl|mozilla|~mozilla public licen[sc]e
mpl|mpl|~mpl(?: 2 0| 1 1)|~mpl licen[sc]ed?
epl-2.0|eclipse|=eclipse public licen[sc]e(?: v| version)? ?2(?: 0)?|~www eclipse org legal epl (?:v20|2 0)(?: html)?
epl-1.0|eclipse|=eclipse public licen[sc]e(?: v| version)? ?1(?: 0)?|~www eclipse org legal epl v10(?: html)?
epl|eclipse|~eclipse public licen[sc]e
edl-1.0|eclipse|=eclipse distribution licen[sc]e(?: v| version)? ?1 0
cddl-1.0|common|=common development and distribution licen[sc]e(?: cddl)?(?: v| version)? ?1(?: 0)?
cddl-1.1|common|=common development and distribution licen[sc]e(?: cddl)?(?: v| version)? ?1 1
cddl|common|~common development and distribution licen[sc]e
cddl|cddl|~cddl(?: 1 [01])?
cpl-1.0|common|=common public licen[sc]e(?: v| version)? ?1 0|~common public licen[sc]e
cpal-1.0|common|=common public attribution licen[sc]e(?: version)?(?: 1 0)?
cc-by-nc-nd-4.0|cc|=cc by nc nd 4 0|~cc by nc nd(?: [1-3] 0)?
cc-by-nc-sa-4.0|cc|=cc by nc sa 4 0|~cc by nc sa(?: [1-3] 0)?
cc-by-nc-4.0|cc|=licensed under cc by nc 4 0|=cc by nc 4 0|~cc by nc(?: [1-3] 0)?
cc-by-nd-4.0|cc|=cc by nd 4 0|~cc by nd(?: [1-3] 0)?
cc-by-sa-4.0|cc|=cc by sa 4 0|~cc by sa(?: [1-3] 0)?
cc-by-4.0|cc|=licensed under cc by 4 0|=cc by 4 0|~cc by(?: [1-3] 0)
cc0-1.0|cc0|=cc0 1 0(?: universal)?|~cc0
cc-by-nc-nd|creative|=creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: works)?(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-sa|creative|=creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc|creative|=creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?
cc-by-nd|creative|=creative commons attribution no ?deriv(?:atives|s)(?: works)?(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?
cc-by-sa|creative|=creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?
cc-by|creative|=creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?
cc0-1.0|creative|=creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc|creative|~creative commons licen[sc]e|~licensed under a creative commons licen[sc]e
cc-by|creativecommons|~creativecommons org licenses by(?: [1-4] 0)?|~creativecommons org licenses by nc(?: [1-4] 0)?|~creativecommons org licenses by sa(?: [1-4] 0)?|~creativecommons org licenses by nc sa(?: [1-4] 0)?|~creativecommons org licenses by nc nd(?: [1-4] 0)?|~creativecommons org licenses by nd(?: [1-4] 0)?
cc0-1.0|creativecommons|=creativecommons org publicdomain zero 1 0
unlicense|unlicense|=the unlicense|~unlicense org
unlicense|unencumbered|=this is free and unencumbered software released into the public domain
public-domain|public|=released into the public domain|=dedicated to the public domain|=placed in the public domain|~in the public domain|~public domain dedication
wtfpl|fuck|=do what the fuck you want to public licen[sc]e(?: version 2)?
wtfpl|wtfpl|~wtfpl(?: licen[sc]e)?
zlib|zlib|=zlib licen[sc]e|=zlib libpng licen[sc]e|~zlib style licen[sc]e
zlib|altered|=altered source versions must be plainly marked as such
libpng|libpng|=libpng licen[sc]e
libpng|png|=png reference library licen[sc]e
bsl-1.0|boost|=boost software licen[sc]e(?: version)?(?: 1 0)?|~www boost org license 1 0(?: txt)?
artistic-2.0|artistic|=artistic licen[sc]e(?: version)? 2(?: 0)?
artistic-1.0|artistic|=artistic licen[sc]e(?: version)? 1(?: 0)?
artistic|artistic|~(?:the )?artistic licen[sc]e|~perl artistic licen[sc]e
psf-2.0|python|=python software foundation licen[sc]e(?: version)?(?: 2)?|~python licen[sc]e
psf-2.0|psf|=psf licen[sc]e agreement
ruby|ruby|=ruby licen[sc]e|~same terms as ruby
php-3.01|php|=php licen[sc]e(?: version)?(?: 3 01)?
postgresql|postgresql|=postgresql licen[sc]e
openssl|openssl|=openssl licen[sc]e|~openssl ssleay licen[sc]e
ofl-1.1|sil|=sil open font licen[sc]e(?: version)?(?: 1 1)?|~scripts sil org ofl
ofl-1.1|font|=open font licen[sc]e
odbl-1.0|database|=open (?:data commons open )?database licen[sc]e(?: odbl)?(?: v?1 0)?
odc-by|data|=open data commons attribution licen[sc]e
pddl-1.0|data|=open data commons public domain dedication and licen[sc]e
osl-3.0|open|=open software licen[sc]e(?: v| version)? ?3 0|~open software licen[sc]e
afl-3.0|academic|=academic free licen[sc]e(?: v| version)?(?: 3 0| 2 1)?
ecl-2.0|educational|=educational community licen[sc]e(?: version)?(?: 2 0)?
eupl-1.2|european|=european union public licen[sc]e(?: v| version)?(?: 1 [0-2])?
eupl-1.2|eupl|~eupl(?: v?1 [0-2])?
cecill-2.1|cecill|=cecill(?: b| c)?(?: v?2 1)?(?: licen[sc]e)?
ms-pl|microsoft|=microsoft public licen[sc]e(?: ms pl)?
ms-rl|microsoft|=microsoft reciprocal licen[sc]e(?: ms rl)?
ncsa|illinois|=university of illinois ncsa open source licen[sc]e|~illinois open source licen[sc]e
upl-1.0|universal|=universal permissive licen[sc]e(?: upl)?(?: v| version)?(?: 1 0)?
blueoak-1.0.0|blue|=blue oak model licen[sc]e(?: 1 0 0)?
vim|vim|=vim licen[sc]e
tcl|tcl|=tcl tk licen[sc]e|=tcl licen[sc]e
w3c|w3c|=w3c software (?:notice and )?licen[sc]e|=w3c software and document licen[sc]e
sspl-1.0|server|=server side public licen[sc]e(?: v| version)?(?: 1)?
busl-1.1|business|=business source licen[sc]e(?: v| version)?(?: 1 1)?
elastic-2.0|elastic|=elastic licen[sc]e(?: v| version)?(?: 2(?: 0)?)?
commons-clause|commons|=commons clause(?: licen[sc]e condition)?
polyform|polyform|=polyform (?:noncommercial|small business|shield|strict) licen[sc]e
json|good|=shall be used for good not evil
openrail|rail|=(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?
llama|community|=llama (?:2 |3 |3 1 )?community licen[sc]e(?: agreement)?
proprietary|reserved|~all rights reserved
proprietary|proprietary|=proprietary and confidential|~proprietary licen[sc]e
proprietary|agreement|~end user licen[sc]e agreement
unknown|licen|~licensed under (?:the |a )?(?:terms of )?(?:the )?\S+ licen[sc]e|~see (?:the )?licen[sc]e(?: file)? for (?:details|more information)|~licen[sc]e agreement
"""

#: SPDX lines name a license by its short form: "SPDX-License-Identifier: MIT".
_SPDX = """mit mit-0 x11 apache-1.0 apache-1.1 apache-2.0 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later
lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later
bsd-2-clause bsd-3-clause bsd-4-clause 0bsd isc mpl-1.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 cpl-1.0 cc0-1.0 cc-by-3.0 cc-by-4.0
cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 unlicense wtfpl zlib bsl-1.0 artistic-1.0 artistic-2.0
psf-2.0 ruby php-3.01 postgresql openssl ofl-1.1 odbl-1.0 pddl-1.0 osl-3.0 afl-3.0 ecl-2.0 eupl-1.2 cecill-2.1 ms-pl ms-rl ncsa upl-1.0
blueoak-1.0.0 vim tcl w3c sspl-1.0 busl-1.1 elastic-2.0 json"""


def rules() -> list[Rule]:
    """All rules, the best priority first: SPDX lines, full names, short mentions."""
    found: dict[tuple[str, str], Rule] = {}
    for label in _SPDX.split():
        words = label.replace("-", " ").replace(".", " ")
        found[label, "spdx"] = Rule(label, 0, 1.0, "spdx", f"spdx license identifier {words}")
    for line in _SIGNATURES.strip().split("\n"):
        # Patterns hold alternations of their own inside parentheses, so that only "|=" and "|~" part them.
        label, keyword, rest = line.split("|", 2)
        for part in rest.replace("|=", "\n=").replace("|~", "\n~").split("\n"):
            full, pattern = part[0] == "=", part[1:]
            found.setdefault((label, pattern), Rule(label, 1 if full else 2, 0.95 if full else 0.6, keyword, pattern))
    return sorted(found.values(), key=lambda r: (r.priority, r.label, r.pattern))


RULES = rules()

#: Words that gate many rules at once, the most common first.
_STRONG = ("licen", "permission", "spdx", "gpl", "apache", "creative", "mozilla", "eclipse", "redistribution", "domain", "cc by")


def _certain(pattern: str) -> str:
    """What is in every match: the pattern without its groups, which are optional or have alternatives."""
    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\(\?:[^()]*\)(\?|\{[^}]*\})?", "\n", pattern)
    return pattern


#: Without one of these no rule and no base phrase can match: for each rule a word of every match.
GATE = tuple(sorted({next((g for g in _STRONG if g in _certain(r.pattern)), r.keyword) for r in RULES} - {"cc by"}))


def gated(column: Column) -> Column:
    """Whether a text holds a word of the gate, in either case, so that rules and base phrases are worth trying."""
    low = F.lower(column)
    out = low.rlike("cc[^0-9a-z]+by")
    for word in GATE:
        out = F.contains(low, F.lit(word)) | out
    return F.coalesce(out, F.lit(False))


def canonical(column: Column) -> Column:
    """' word word ... ': A-Z lower-cased, one space around each word; ' ' if there is none."""
    joined = F.regexp_replace(F.translate(column, _UPPER, _UPPER.lower()), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(joined), F.when(F.trim(joined) == "", F.lit("")).otherwise(F.lit(" ")))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def whole(pattern: str) -> str:
    """A regular expression for ``pattern`` as whole words of a canonical text."""
    return f"((?<= )(?:{pattern})(?= ))"


def places(column: Column, pattern: Column) -> Column:
    """Intervals of words (first, word after the last) of the matches in a canonical text of a pattern made by ``whole``."""
    # Words never hold control characters: these mark where a match begins and ends. Then places are read by index.
    marked = F.regexp_replace(column, pattern, "\u0001$1\u0002")

    def at(words: Column, sign) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(sign(w), i)), lambda i: i.isNotNull())

    def read(words: Column) -> Column:
        begins, ends = at(words, lambda w: w.startswith("\u0001")), at(words, lambda w: w.endswith("\u0002"))
        # The text begins with a space, so that its first word has the index 1.
        return F.zip_with(begins, ends, lambda a, b: F.struct((a - 1).alias("a"), b.alias("b")))

    return let(F.split(marked, " ", -1), read)


def _rules_column() -> Column:
    """The rules as one constant, so that the plan doesn't grow with their number."""
    rows = [{"priority": r.priority, "label": r.label, "weight": r.weight, "keyword": r.keyword, "pattern": whole(r.pattern)} for r in RULES]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<priority:int,label:string,weight:double,keyword:string,pattern:string>>")


def detections(column: Column) -> Column:
    """All rules' matches in a canonical text, unsuppressed: array of (a, b, priority, label, weight)."""
    # First one pattern for all rules of a keyword, a literal that is compiled once; then those rules of the few left.
    by_keyword: dict[str, list[str]] = {}
    for r in RULES:
        by_keyword.setdefault(r.keyword, []).append(r.pattern)
    hit = [F.when(F.contains(column, F.lit(k)) & column.rlike(whole("|".join(p))), F.lit(k)) for k, p in sorted(by_keyword.items())]
    matched = let(F.array_compact(F.array(*hit)), lambda keys: F.filter(_rules_column(), lambda r: F.array_contains(keys, r["keyword"]) & F.regexp_like(column, r["pattern"])))

    def intervals(r: Column) -> Column:
        return F.transform(places(column, r["pattern"]), lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))

    return F.flatten(F.transform(matched, intervals))


def unsuppressed(found: Column) -> Column:
    """``found`` without intervals inside a longer one, or equal to one of a better priority (then of the smaller label).

    In order of their begins, the longer and better ones first, those stay that end later than all before them. The
    furthest end before a place is that of whole runs of about the square root of their number, and of its own run so far.
    """

    def later(a: Column, b: Column) -> Column:
        order = [(a["a"], b["a"]), (b["b"], a["b"]), (a["priority"], b["priority"]), (a["label"], b["label"])]
        out = F.lit(0)
        for x, y in reversed(order):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    def kept(order: Column) -> Column:
        run = F.greatest(F.ceil(F.sqrt(F.size(order))), F.lit(1)).cast("int")
        state = F.struct(order.alias("order"), F.transform(order, lambda d: d["b"]).alias("ends"), run.alias("run"))
        return let(state, lambda s: let(furthest(s), lambda whole: chosen(s, whole)))

    def furthest(s: Column) -> Column:
        runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s["ends"]) / s["run"]).cast("int") - 1, F.lit(0)))
        return F.transform(runs, lambda k: F.array_max(F.slice(s["ends"], k * s["run"] + 1, s["run"])))

    def chosen(s: Column, whole: Column) -> Column:
        def stays(d: Column, i: Column) -> Column:
            runs, inside = F.floor(i / s["run"]).cast("int"), (i % s["run"]).cast("int")
            before = F.greatest(F.array_max(F.slice(whole, F.lit(1), runs)), F.array_max(F.slice(s["ends"], runs * s["run"] + 1, inside)))
            return F.when(d["b"] > F.coalesce(before, F.lit(-1)), d)

        return F.filter(F.transform(s["order"], stays), lambda d: d.isNotNull())

    return let(F.array_sort(found, later), kept)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("bigint")
    read = documents.select(F.col(id_col).alias("doc_id"), words.alias("n_words"), F.when(gated(F.col(text_col)), canonical(F.col(text_col))).alias("_form"))
    phrases = [F.when(F.contains("_form", F.lit(p)), places(F.col("_form"), F.lit(whole(p)))) for p, _ in BASE]
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    based = read.withColumn("_base", F.array(*(F.coalesce(p, nothing) for p in phrases)))
    found = based.withColumn("_found", F.when(F.col("_form").isNotNull(), detections(F.col("_form"))))
    kept = found.withColumn("detections", F.when(F.col("_found").isNotNull(), unsuppressed(F.col("_found"))))
    starts = F.transform(F.flatten("_base"), lambda m: m["a"].cast("bigint"))
    labels = F.filter(F.array(*(F.when(F.size(F.col("_base")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))), lambda x: x.isNotNull())
    more = F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
    doubt = F.aggregate(F.coalesce(F.transform("detections", lambda d: d["weight"]), F.array().cast("array<double>")), F.lit(1.0), lambda a, w: a * (F.lit(1.0) - w))
    base_doubt = F.when(F.size(labels) > 0, F.lit(0.4)).otherwise(F.lit(1.0))
    return kept.select(
        "doc_id",
        "n_words",
        F.size(F.flatten("_base")).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, more))), ",").alias("labels"),
        (F.lit(1.0) - doubt * base_doubt).alias("score"),
        "detections",
    )
