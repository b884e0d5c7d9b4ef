"""License scan with DataFrame functions only: ordered signature rules over normalised words.

Every rule has a label, a priority, a keyword and a hand-written regular expression. A text that
holds none of the gate words is done; otherwise a rule's expression runs only if the text holds
its keyword. Detections are intervals, taken from the highest priority down (of one priority the
earlier, then the longer first). One that lies inside an earlier one is dropped; one that overlaps one
that stands is dropped too, but covers what lies inside it. So a long statement wins over its parts,
a label over a generic line about it, and no two that stand overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.llm._spark import free
from metrolith.llm.urlfilter import LOWER, UPPER

#: A text without any of these has no detection: whatever a rule matches holds one of them.
GATES = (
    "licen", "copyright", "rights reserved", "public domain", "publicdomain", "creative commons", " cc ", "cc0", "spdx", "gpl", "apache", "bsd", "warranty", "without fee", "redistribut", "terms ",
    "without restriction", "free of charge", "mit no attribution", "commons clause", "endorse or promote", "advertising materials",
)

#: label; priority; keyword; expression. Texts are words between single spaces, A-Z lower-cased.
RULES = r"""
spdx; 60; spdx; spdx license identifier [a-z0-9]+(?: \d+){0,3}(?: (?:only|or later))?
mit; 90; spdx; spdx license identifier mit
mit; 80; mit licen; (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat) licen[cs]e
mit; 70; mit licen; (?:the )?mit licen[cs]e(?: mit)?
mit; 85; without restriction; permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0; 88; mit no attribution; mit no attribution(?: licen[cs]e)?
mit-x11; 82; x11 licen; (?:mit )?x11 licen[cs]e
expat; 78; expat licen; expat licen[cs]e
apache-2.0; 95; spdx; spdx license identifier apache 2 0
apache-2.0; 90; apache licen; (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache licen[cs]e(?: version)? 2(?: 0)?
apache-2.0; 85; apache licen; apache licen[cs]e(?: version)? 2(?: 0)?
apache-2.0; 80; apache; apache (?:software )?(?:v|v2|2|2 0) licen[cs]e
apache-2.0; 82; apache org; (?:http|https) www apache org licenses license 2 0
apache-1.1; 84; apache; apache (?:software )?licen[cs]e(?: version)? 1 1
apache-1.0; 83; apache; apache (?:software )?licen[cs]e(?: version)? 1 0
apache; 60; apache licen; apache (?:software )?licen[cs]e
gpl-3.0; 95; gpl; spdx license identifier gpl 3 0(?: (?:only|or later))?
gpl-2.0; 95; gpl; spdx license identifier gpl 2 0(?: (?:only|or later))?
gpl-3.0; 92; general public licen; (?:gnu )?general public licen[cs]e (?:as published by the free software foundation (?:either )?)?version 3
gpl-3.0+; 94; general public licen; (?:gnu )?general public licen[cs]e (?:as published by the free software foundation (?:either )?)?version 3 (?:of the license )?or (?:at your option )?any later version
gpl-2.0; 92; general public licen; (?:gnu )?general public licen[cs]e (?:as published by the free software foundation (?:either )?)?version 2
gpl-2.0+; 94; general public licen; (?:gnu )?general public licen[cs]e (?:as published by the free software foundation (?:either )?)?version 2 (?:of the license )?or (?:at your option )?any later version
gpl-1.0; 90; general public licen; (?:gnu )?general public licen[cs]e version 1
gpl; 60; general public licen; (?:gnu )?general public licen[cs]e
gpl-3.0; 80; gpl; (?:gnu )?gpl ?(?:v|version )?3(?: 0)?
gpl-2.0; 80; gpl; (?:gnu )?gpl ?(?:v|version )?2(?: 0)?
gpl; 50; gpl; (?:the )?gnu gpl
lgpl-3.0; 96; lesser general public licen; (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation either)? version 3
lgpl-2.1; 96; lesser general public licen; (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation either)? version 2 1
lgpl; 75; lesser general public licen; (?:gnu )?lesser general public licen[cs]e
lgpl-2.0; 94; library general public licen; (?:gnu )?library general public licen[cs]e(?: version 2)?
lgpl-3.0; 84; lgpl; (?:gnu )?lgpl ?(?:v|version )?3(?: 0)?
lgpl-2.1; 84; lgpl; (?:gnu )?lgpl ?(?:v|version )?2 1
lgpl; 55; lgpl; (?:gnu )?lgpl
agpl-3.0; 97; affero general public licen; (?:gnu )?affero general public licen[cs]e(?: version)? 3(?: 0)?
agpl; 76; affero general public licen; (?:gnu )?affero general public licen[cs]e
agpl-3.0; 85; agpl; (?:gnu )?agpl ?(?:v|version )?3(?: 0)?
agpl; 56; agpl; (?:gnu )?agpl
gfdl; 86; free documentation licen; (?:gnu )?free documentation licen[cs]e(?: version 1 \d)?
gpl-exception; 88; gpl; gpl (?:with|plus) (?:the )?(?:classpath|linking|runtime library|font|autoconf|bison) exception
bsd-3-clause; 95; spdx; spdx license identifier bsd 3 clause
bsd-2-clause; 95; spdx; spdx license identifier bsd 2 clause
bsd-3-clause; 88; bsd; (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-2-clause; 88; bsd; (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|free ?bsd)(?: licen[cs]e)
bsd-4-clause; 88; bsd; (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)?
0bsd; 89; bsd; (?:zero clause bsd|0bsd)(?: licen[cs]e)?
bsd; 60; bsd; bsd(?: style)? licen[cs]e
bsd-3-clause; 86; redistribut; redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd-3-clause; 84; endorse or promote; may be used to endorse or promote products derived from this software
bsd-4-clause; 84; advertising materials; all advertising materials mentioning features or use of this software
isc; 85; isc licen; isc licen[cs]e
isc; 83; without fee; permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
mpl-2.0; 92; mozilla public licen; mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
mpl-1.1; 92; mozilla public licen; mozilla public licen[cs]e(?: version| v)? 1 1
mpl; 65; mozilla public licen; mozilla public licen[cs]e
epl-2.0; 92; eclipse public licen; eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
epl-1.0; 92; eclipse public licen; eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
epl; 65; eclipse public licen; eclipse public licen[cs]e
edl; 80; eclipse distribution licen; eclipse distribution licen[cs]e
cddl; 80; common development and distribution; common development and distribution licen[cs]e(?: version 1 \d)?
cpl; 80; common public licen; common public licen[cs]e(?: version 1 0)?
ipl; 80; ibm public licen; ibm public licen[cs]e
apsl; 80; apple public source; apple public source licen[cs]e
artistic-2.0; 88; artistic licen; artistic licen[cs]e(?: version)? 2(?: 0)?
artistic; 65; artistic licen; artistic licen[cs]e
perl; 82; same terms as perl; (?:under )?the same terms as perl(?: itself)?
psf; 85; python software foundation; python software foundation licen[cs]e(?: version 2)?
php; 80; php licen; php licen[cs]e(?: version 3 0\d?)?
ruby; 75; ruby licen; ruby(?: s)? licen[cs]e
zlib; 82; zlib; zlib(?: libpng)? licen[cs]e
libpng; 80; libpng licen; libpng licen[cs]e
openssl; 80; openssl licen; openssl licen[cs]e
curl; 75; curl licen; curl licen[cs]e
boost-1.0; 90; boost software licen; boost software licen[cs]e(?: version)?(?: 1 0)?
bsl-1.1; 88; business source licen; business source licen[cs]e(?: version)?(?: 1 1)?
sspl; 88; server side public licen; server side public licen[cs]e(?: version 1)?
elastic-2.0; 84; elastic licen; elastic licen[cs]e(?: version)?(?: 2 0)?
commons-clause; 84; commons clause; commons clause(?: licen[cs]e)?(?: condition)?
eupl; 85; european union public licen; european union public licen[cs]e(?: version)?(?: 1 \d)?
cecill; 80; cecill; cecill(?: [abc])?(?: free software)? licen[cs]e
ofl; 85; open font licen; (?:sil )?open font licen[cs]e(?: version)?(?: 1 \d)?
postgresql; 80; postgresql licen; postgresql licen[cs]e
ncsa; 80; ncsa; (?:university of illinois )?ncsa open source licen[cs]e
ms-pl; 82; microsoft public licen; microsoft public licen[cs]e
ms-rl; 82; microsoft reciprocal licen; microsoft reciprocal licen[cs]e
upl; 80; universal permissive licen; universal permissive licen[cs]e
osl; 80; open software licen; open software licen[cs]e(?: version)?(?: 3 0)?
afl; 80; academic free licen; academic free licen[cs]e(?: version)?(?: \d \d)?
ecl; 80; educational community licen; educational community licen[cs]e
qpl; 78; q public licen; q public licen[cs]e
sleepycat; 78; sleepycat licen; sleepycat licen[cs]e
wtfpl; 82; do what the; do what the f\S* you want to public licen[cs]e
beerware; 76; ware licen; beer ?ware licen[cs]e
unlicense; 88; unlicense; (?:the )?unlicense
unlicense; 84; public domain; this is free and unencumbered software released into the public domain
public-domain; 60; public domain; (?:released|dedicated|placed|is|are)(?: in| into| to)? (?:in )?(?:the )?public domain
cc0-1.0; 92; cc; (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-pdm; 82; public domain mark; (?:creative commons )?public domain mark(?: 1 0)?
cc-by-nc-nd; 96; cc; cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa; 96; cc; cc by nc sa(?: [1-4] [05])?
cc-by-nc; 94; cc; cc by nc(?: [1-4] [05])?
cc-by-nd; 94; cc; cc by nd(?: [1-4] [05])?
cc-by-sa; 94; cc; cc by sa(?: [1-4] [05])?
cc-by; 90; cc; cc by(?: [1-4] [05])?
cc-by-nc-nd; 97; creative commons; creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?
cc-by-nc-sa; 97; creative commons; creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc; 95; creative commons; creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd; 95; creative commons; creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?
cc-by-sa; 95; creative commons; creative commons attribution share ?alike(?: [1-4] [05])?
cc-by; 91; creative commons; creative commons attribution(?: [1-4] [05])?
creative-commons; 55; creative commons; creative commons(?: licen[cs]e)?
cc-by-nc-nd; 93; creativecommons; creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa; 93; creativecommons; creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc; 92; creativecommons; creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd; 92; creativecommons; creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa; 92; creativecommons; creativecommons org licenses by sa(?: [1-4] [05])?
cc-by; 91; creativecommons; creativecommons org licenses by(?: [1-4] [05])?
cc0-1.0; 93; creativecommons; creativecommons org publicdomain zero(?: 1 0)?
odbl; 84; open database licen; open (?:data commons )?(?:open )?database licen[cs]e(?: odbl)?
odc-by; 82; open data commons attribution; open data commons attribution licen[cs]e
pddl; 84; public domain dedication and licen; (?:open data commons )?public domain dedication and licen[cs]e
cdla; 80; community data licen; community data licen[cs]e agreement(?: permissive| sharing)?
ogl; 80; open government licen; open government licen[cs]e(?: v?\d(?: 0)?)?
rail; 78; responsible ai licen; (?:open )?responsible ai licen[cs]e
llama; 78; community licen; llama \d(?: \d)? community licen[cs]e
copyright; 40; copyright; copyright(?: c)?(?: (?:19|20)\d\d)+(?: [^ ]+)?
copyright; 30; copyright; copyright(?: c)? (?:by|of|notice|holder)
all-rights-reserved; 50; rights reserved; all rights reserved
some-rights-reserved; 50; rights reserved; some rights reserved
proprietary; 70; licen; proprietary(?: software)? licen[cs]e
proprietary; 68; redistribut; (?:no|not|without) (?:permission )?(?:for |to )?redistribut(?:e|ion|ed)
proprietary; 66; licen; end user licen[cs]e agreement
commercial; 64; licen; commercial licen[cs]e
permission; 45; copyright; reproduced (?:with|by) permission
no-warranty; 35; warranty; without (?:any )?warranty(?: of any kind)?
terms-of-use; 35; terms of; terms of (?:use|service)
license-line; 20; licen; (?:released|licensed|distributed|available) under (?:the |a )?[^ ]+(?: [^ ]+){0,4}? licen[cs]e
license-line; 15; licen; (?:see|read) (?:the )?(?:file )?licen[cs]e(?: file| txt| md)?
license-line; 10; licen; licen[cs]ed? under
"""

#: label, phrase
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


#: Labels that are no licenses of a name of their own.
GENERIC = frozenset("spdx license-line copyright all-rights-reserved some-rights-reserved proprietary commercial permission no-warranty terms-of-use public-domain".split())


def rules(text: str = RULES) -> list[tuple[str, int, str, str]]:
    """label, priority, keyword and expression of the rules above, and of one rule a label for its SPDX identifier."""
    out = [(a, int(b), c, d) for a, b, c, d in (tuple(x.split("; ", 3)) for x in text.strip().splitlines())]
    for label in sorted({x[0] for x in out} - GENERIC):
        words = label.replace("+", " or later").replace("-", " ").replace(".", " ")
        out.append((label, 98 if label.endswith("+") else 95, "spdx", f"spdx license identifier {words}"))
    return out


def words_of(text: Column) -> Column:
    """The words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with a space before and after each; ` ` for none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("bigint")


def _detections(norm: Column, table: list[tuple[str, int, str, str]]) -> Column:
    """array<struct(priority, start, end, label)> in characters of the normalised text, highest priority first."""
    each = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("priority"), F.lit(c).alias("keyword"), F.lit(f"(?<= ){d}(?= )").alias("regex")) for a, b, c, d in table])
    mine = F.filter(each, lambda r: norm.contains(r["keyword"]))

    def places(r: Column) -> Column:
        hits = F.regexp_extract_all(norm, r["regex"], F.lit(0))
        gaps = F.split(norm, r["regex"], -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            a = acc["at"] + F.length(p["g"])
            b = a + F.length(p["h"])
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), r["priority"].alias("priority"), r["label"].alias("label")))).alias("out"))

        return F.aggregate(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))), start, lambda acc, p: F.when(p["h"].isNull(), acc).otherwise(step(acc, p)), lambda acc: acc["out"])

    found = F.flatten(F.transform(mine, places))
    ordered = F.transform(found, lambda d: F.struct((-d["priority"]).alias("priority"), d["start"].alias("start"), (-d["end"]).alias("end"), d["label"].alias("label")))
    return F.array_sort(ordered)


_STATE = "struct<seen:array<struct<start:int,end:int,stay:boolean>>,labels:array<string>,n:bigint,best:int>"


def scan(docs: DataFrame, column: str = "text", table: list[tuple[str, int, str, str]] | None = None) -> DataFrame:
    """Adds what the base phrases and the rules find in every whole text.

    Adds n_words, n_base, first_word and last_word long (places of base phrases, words from 0),
    base_labels and labels string (distinct, sorted, comma-joined), n_detections long (those
    that stand after suppression) and score double: 1 with a base phrase, else the highest
    priority found, in hundredths, else 0.

    Null and empty texts: no words, no places, empty labels, score 0, null first and last word.
    Repeated rows give repeated results; an empty table none; an older column of an added name is
    replaced.
    """
    table = table or rules()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_detections", "score")
    own = {c: free(docs, f"its {c}") for c in ("norm", "n", "gate", "found", *(label for label, _ in BASE))}
    col = lambda c: F.col(f"`{own[c]}`")
    out = docs.withColumn(own["norm"], words_of(F.col(column)))
    norm = col("norm")
    gate = F.lit(False)
    for g in GATES:
        gate = gate | norm.contains(g)
    out = out.withColumns({own["n"]: _spaces(norm) - 1, own["gate"]: gate})
    for label, phrase in BASE:
        gaps = F.when(col("gate") & norm.contains(f" {phrase} "), F.split(norm, f"(?<= ){phrase}(?= )", -1))
        out = out.withColumn(own[label], gaps)
    n = {label: F.when(col(label).isNull(), F.lit(0).cast("bigint")).otherwise(F.size(col(label)).cast("bigint") - 1) for label, _ in BASE}
    first = [_spaces(F.get(col(label), F.lit(0))) - 1 for label, _ in BASE]
    last = [col("n") - len(phrase.split()) - (_spaces(F.element_at(col(label), -1)) - 1) for label, phrase in BASE]
    start = F.struct(F.array().alias("seen"), F.array().cast("array<string>").alias("labels"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("best")).cast(_STATE)

    def keep(acc: Column, d: Column) -> Column:
        a, b = d["start"], -d["end"]
        # what a dropped line covers stays covered: `licensed under` of a longer line does not come back
        inside = F.exists(acc["seen"], lambda k: (k["start"] <= a) & (k["end"] >= b))
        across = F.exists(acc["seen"], lambda k: k["stay"] & (k["start"] < b) & (k["end"] > a))
        seen = lambda stay: F.array_append(acc["seen"], F.struct(a.alias("start"), b.alias("end"), F.lit(stay).alias("stay"))).alias("seen")
        dropped = F.struct(seen(False), acc["labels"].alias("labels"), acc["n"].alias("n"), acc["best"].alias("best"))
        stay = F.struct(seen(True), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), (acc["n"] + 1).alias("n"), F.greatest(acc["best"], -d["priority"]).alias("best"))
        return F.when(inside, acc).when(across, dropped).otherwise(stay).cast(_STATE)

    found = F.when(col("gate"), F.aggregate(_detections(norm, table), start, keep))
    out = out.withColumn(own["found"], found)
    base = F.array_compact(F.array(*[F.when(n[label] > 0, F.lit(label)) for label, _ in BASE]))
    total = sum((n[label] for label, _ in BASE[1:]), n[BASE[0][0]])
    labels = F.array_union(base, F.coalesce(F.col(f"`{own['found']}`.labels"), F.array().cast("array<string>")))
    added = {
        "n_words": col("n"),
        "n_base": total,
        "first_word": F.least(*first),
        "last_word": F.greatest(*last),
        "base_labels": F.array_join(F.array_sort(base), ","),
        "labels": F.array_join(F.array_sort(labels), ","),
        "n_detections": F.coalesce(F.col(f"`{own['found']}`.n"), F.lit(0).cast("bigint")),
        "score": F.when(total > 0, F.lit(1.0)).otherwise(F.coalesce(F.col(f"`{own['found']}`.best") / 100.0, F.lit(0.0))).cast("double"),
    }
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names], *[v.alias(n) for n, v in added.items()])
