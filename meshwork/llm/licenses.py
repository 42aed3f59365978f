"""Licence scans by ordered signature rules (DataFrame functions only; no shuffle).

A text becomes its words (runs of letters, digits and non-ASCII characters, A-Z lower-cased), joined by single blanks.  Rules are regular
expressions over that string, each behind keywords of which the text must contain one; a text that has no general licence word is not looked at further.
Overlapping detections are taken in order of (priority, longest first, start, label): one that lies inside a detection that stays, or overlaps one that stays and
has better priority, is suppressed; of equal priority two that overlap partly both stay.  Only a detection that stays suppresses.

Beside these rules, base phrases (mit license; apache license; general public license) are found at every place where their words stand consecutively.

Defined cases: null or empty text has no words; repeated rows are scanned each; a null doc_id is like any other; a text of any length is scanned whole; equal
detections of one rule set count once; an empty table gives an empty table; other columns, whatever their names, don't matter.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import ascii_lower, slim

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text without any of these is not scanned by the rules; every match of a rule, with the blank before it, has one.
GATE = r"licen[cs]|copyright|copyleft| spdx | public domain | creative commons | cc0 | cc by | gpl| lgpl| agpl| mpl| openrail| rights reserved | warrant| eula |unlicense|wtfpl| permission is hereby granted | permission to use copy | redistribution and use in source | proprietary and confidential | confidential and proprietary | copying file "
BASE = r"(?<= )(?:mit|apache)(?= license )|(?<= )general(?= public license )"
LICENSE = "(?:software |open source |public )?licen[cs]e"
#: label: keywords (every match of the name has one of them), the name as a regular expression over words, versions.
FAMILIES = {
    "mit": ("mit|expat", f"(?:the )?(?:mit|expat|mit x11|x11 mit) {LICENSE}", ""),
    "mit-0": ("mit", f"(?:the )?mit (?:no attribution|0) {LICENSE}", ""),
    "apache": ("apache", f"(?:the )?apache (?:software foundation )?{LICENSE}", "1 0|1 1|2 0|2"),
    "gpl": ("general", "(?:the )?(?:gnu )?general public licen[cs]e", "1|1 0|2|2 0|3|3 0"),
    "gpl-short": ("gpl", "(?:the )?(?:gnu )?gpl(?: licen[cs]e)?", "1|2|2 0|3|3 0"),
    "lgpl": ("lesser|library", "(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e", "2|2 0|2 1|3|3 0"),
    "lgpl-short": ("lgpl", "(?:the )?(?:gnu )?lgpl(?: licen[cs]e)?", "2|2 0|2 1|3|3 0"),
    "agpl": ("affero", "(?:the )?(?:gnu )?affero general public licen[cs]e", "1|1 0|3|3 0"),
    "agpl-short": ("agpl", "(?:the )?(?:gnu )?agpl(?: licen[cs]e)?", "1|3|3 0"),
    "gfdl": ("documentation", "(?:the )?(?:gnu )?free documentation licen[cs]e", "1 1|1 2|1 3"),
    "bsd-2-clause": ("bsd", f"(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd) {LICENSE}", ""),
    "bsd-3-clause": ("bsd", f"(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) {LICENSE}", ""),
    "bsd-4-clause": ("bsd", f"(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) {LICENSE}", ""),
    "0bsd": ("bsd|free public", f"(?:the )?(?:bsd zero clause|zero clause bsd|0bsd|free public) {LICENSE}", ""),
    "bsd": ("bsd", f"(?:the )?bsd(?: style)? {LICENSE}", ""),
    "isc": ("isc", f"(?:the )?isc {LICENSE}", ""),
    "mpl": ("mozilla", "(?:the )?mozilla public licen[cs]e", "1 0|1 1|2 0"),
    "mpl-short": ("mpl", "(?:the )?mpl(?: licen[cs]e)?", "1 0|1 1|2 0"),
    "epl": ("eclipse", "(?:the )?eclipse public licen[cs]e", "1 0|2 0"),
    "edl": ("eclipse", "(?:the )?eclipse distribution licen[cs]e", "1 0"),
    "cddl": ("common", "(?:the )?common development and distribution licen[cs]e", "1 0|1 1"),
    "cpl": ("common", "(?:the )?common public licen[cs]e", "1 0"),
    "eupl": ("european", "(?:the )?european union public licen[cs]e", "1 0|1 1|1 2"),
    "artistic": ("artistic", f"(?:the )?(?:clarified )?artistic {LICENSE}", "1 0|2 0"),
    "zlib": ("zlib", f"(?:the )?zlib(?: libpng)? {LICENSE}", ""),
    "boost": ("boost", f"(?:the )?boost {LICENSE}", "1 0"),
    "python": ("python|psf", f"(?:the )?(?:python software foundation|psf|python) {LICENSE}", "2|2 0"),
    "ofl": ("open", "(?:the )?(?:sil )?open font licen[cs]e", "1 0|1 1"),
    "odbl": ("database", "(?:the )?open (?:data commons )?(?:open )?database licen[cs]e", "1 0"),
    "odc-by": ("attribution", "(?:the )?open data commons attribution licen[cs]e", "1 0"),
    "pddl": ("dedication", "(?:the )?public domain dedication(?: and licen[cs]e)?", "1 0"),
    "ms-pl": ("microsoft", "(?:the )?microsoft public licen[cs]e", ""),
    "ms-rl": ("microsoft", "(?:the )?microsoft reciprocal licen[cs]e", ""),
    "apsl": ("apple", "(?:the )?apple public source licen[cs]e", "1 0|1 1|1 2|2 0"),
    "npl": ("netscape", "(?:the )?netscape public licen[cs]e", "1 0|1 1"),
    "osl": ("open", f"(?:the )?open {LICENSE}", "1 0|1 1|2 0|2 1|3 0"),
    "afl": ("academic", "(?:the )?academic free licen[cs]e", "1 1|1 2|2 0|2 1|3 0"),
    "bsl": ("business", "(?:the )?business source licen[cs]e", "1 0|1 1"),
    "sspl": ("server", "(?:the )?server side public licen[cs]e", "1|1 0"),
    "elastic": ("elastic", f"(?:the )?elastic {LICENSE}", "1 0|2 0"),
    "upl": ("universal", "(?:the )?universal permissive licen[cs]e", "1 0"),
    "vim": ("vim", f"(?:the )?vim {LICENSE}", ""),
    "php": ("php", f"(?:the )?php {LICENSE}", "3 0|3 01"),
    "openssl": ("openssl", f"(?:the )?openssl {LICENSE}", ""),
    "w3c": ("w3c", "(?:the )?w3c (?:software notice and |software )?licen[cs]e", ""),
    "ncsa": ("ncsa", f"(?:the )?(?:university of illinois )?ncsa {LICENSE}", ""),
    "postgresql": ("postgresql", f"(?:the )?postgresql {LICENSE}", ""),
    "curl": ("curl", f"(?:the )?curl {LICENSE}", ""),
    "json": ("json", f"(?:the )?json {LICENSE}", ""),
    "unlicense": ("unlicense", "(?:the )?unlicense", ""),
    "wtfpl": ("wtfpl", "(?:the )?wtfpl(?: licen[cs]e)?", "1|2"),
    "openrail": ("openrail", f"(?:the )?(?:creativeml )?openrail(?: m)?(?: {LICENSE})?", ""),
    "cc-by": ("attribution", "(?:the )?creative commons attribution(?: international| unported| generic)?(?: licen[cs]e)?", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-sa": ("alike", "(?:the )?creative commons attribution share ?alike(?: international| unported| generic)?(?: licen[cs]e)?", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nd": ("derivatives", "(?:the )?creative commons attribution no ?derivatives(?: international| unported| generic)?(?: licen[cs]e)?", "2 0|2 5|3 0|4 0"),
    "cc-by-nc": ("commercial", "(?:the )?creative commons attribution non ?commercial(?: international| unported| generic)?(?: licen[cs]e)?", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nc-sa": ("alike", "(?:the )?creative commons attribution non ?commercial share ?alike(?: international| unported| generic)?(?: licen[cs]e)?", "2 0|2 5|3 0|4 0"),
    "cc-by-nc-nd": ("derivatives", "(?:the )?creative commons attribution non ?commercial no ?derivatives(?: international| unported| generic)?(?: licen[cs]e)?", "2 0|2 5|3 0|4 0"),
    "cc0": ("cc0", "(?:the )?(?:creative commons )?(?:zero |cc zero )?cc0(?: public domain dedication| licen[cs]e)?", "1 0"),
    "cc-by-short": ("cc", "(?:the )?cc by(?: licen[cs]e)?", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-sa-short": ("cc", "(?:the )?cc by sa(?: licen[cs]e)?", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nd-short": ("cc", "(?:the )?cc by nd(?: licen[cs]e)?", "2 0|2 5|3 0|4 0"),
    "cc-by-nc-short": ("cc", "(?:the )?cc by nc(?: licen[cs]e)?", "1 0|2 0|2 5|3 0|4 0"),
    "cc-by-nc-sa-short": ("cc", "(?:the )?cc by nc sa(?: licen[cs]e)?", "2 0|2 5|3 0|4 0"),
    "cc-by-nc-nd-short": ("cc", "(?:the )?cc by nc nd(?: licen[cs]e)?", "2 0|2 5|3 0|4 0"),
}
#: Rules that no family covers: label, keywords, expression, priority, confidence.
SINGLE = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 1, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.9),
    ("gpl", "gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1, 0.95),
    ("apache", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", 1, 0.95),
    ("public-domain", "public", "(?:is|are|has been|placed|dedicated|released)(?: hereby)? (?:in|to|into) the public domain", 2, 0.8),
    ("public-domain", "domain", "public domain", 5, 0.4),
    ("proprietary", "rights", "all rights reserved", 4, 0.6),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential|proprietary licen[cs]e)", 3, 0.7),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", 5, 0.3),
    ("no-warranty", "warranty", "(?:without|no) warranty(?: of any kind)?", 6, 0.2),
    ("no-warranty", "warranties", "without warranties or conditions of any kind", 6, 0.2),
    ("unknown", "under", "(?:licensed|released|distributed|published|made available) under (?:the )?(?:terms of )?(?:an?|the|its|this) (?:open |free |same )?licen[cs]e", 7, 0.2),
    ("unknown", "license|licence|copying", "(?:see|read) (?:the )?(?:license|licence|copying) file", 7, 0.2),
]
UNDER = "(?:licen[cs]ed|released|distributed|published|available|provided|covered|work is licensed)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keywords, expression, priority, confidence), the best first; about five for each family."""
    out = list(SINGLE)
    for name, (keyword, expression, versions) in FAMILIES.items():
        label = name.removesuffix("-short")
        out.append((label, keyword, UNDER + expression, 2, 0.9))
        out.append((label, keyword, expression, 4, 0.6))
        if versions:
            version = f"(?: version| v)? (?:{'|'.join(sorted(versions.split('|'), key=len, reverse=True))})(?: or (?:any )?later(?: version)?)?"
            out.append((label, keyword, UNDER + expression + version, 1, 1.0))
            out.append((label, keyword, expression + version, 3, 0.8))
        out.append((label, label.split("-")[0], f"spdx license identifier {label.replace('-', ' ')}(?: [0-9]+)*(?: or later| only)?", 1, 1.0))
    return sorted(out, key=lambda r: (r[3], r[0], r[2]))


def _blanks(x):
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def places(padded, expression):
    """start and end (in words; the end is the first word after) of each match of an expression in a padded text."""
    pieces, matches = F.split(padded, expression, -1), F.regexp_extract_all(padded, expression, F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, k):
        start = acc["at"] + _blanks(F.get(pieces, k))
        end = start + _blanks(F.get(matches, k))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct((start - 1).alias("start"), end.alias("end")))).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, found).otherwise(none)


_HIT = "struct<start:int,end:int,priority:int,label:string,confidence:double>"


def _detections(padded):
    """All matches of all rules of whose keywords the text contains one, in the order of the sweep."""
    table = F.array(*(F.struct(F.array(*map(F.lit, k.split("|"))).alias("keywords"), F.lit(f"(?<= ){e}(?= )").alias("expression"), F.lit(p).alias("priority"), F.lit(n).alias("label"), F.lit(float(c)).alias("confidence")) for n, k, e, p, c in rules()))
    asked = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(padded, k)))
    one = lambda r: F.transform(places(padded, r["expression"]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))
    ordered = F.array_sort(F.flatten(F.transform(asked, one)))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), (-x["neg"]).alias("end"), x["priority"].alias("priority"), x["label"].alias("label"), x["confidence"].alias("confidence")))


def _clusters(hits):
    """The hits, which come in order of start, in runs that overlap."""
    none = F.array().cast(f"array<{_HIT}>")
    start = F.struct(F.array().cast(f"array<array<{_HIT}>>").alias("done"), none.alias("now"), F.lit(0).alias("end"))

    def step(acc, x):
        joins = x["start"] < acc["end"]
        done = F.when(joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(done.alias("done"), F.when(joins, F.concat(acc["now"], F.array(x))).otherwise(F.array(x)).alias("now"), F.when(joins, F.greatest(acc["end"], x["end"])).otherwise(x["end"]).alias("end"))

    return F.aggregate(hits, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def resolved(hits):
    """The detections that stay, of detections in order of start; in order of start."""
    none = F.array().cast(f"array<{_HIT}>")

    def taken(cluster):
        ranked = F.array_sort(F.transform(cluster, lambda x: F.struct(x["priority"].alias("priority"), (x["start"] - x["end"]).alias("short"), x["start"].alias("start"), x["label"].alias("label"), x.alias("hit"))))

        def step(out, r):
            x = r["hit"]
            overlap = lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])
            inside = lambda k: (k["start"] <= x["start"]) & (x["end"] <= k["end"])
            return F.when(F.exists(out, lambda k: overlap(k) & ((k["priority"] < x["priority"]) | inside(k))), out).otherwise(F.concat(out, F.array(x)))

        return F.when(F.size(cluster) < 2, cluster).otherwise(F.aggregate(ranked, none, step))

    return F.array_sort(F.flatten(F.transform(_clusters(hits), taken)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places of base phrases: start, end in words), base_labels, detections, labels, score of each row."""
    none = F.array().cast(f"array<{_HIT}>")
    joined = F.trim(F.regexp_replace(ascii_lower(F.col("text")), NOT_WORD, " "))
    rows = slim(docs).select("doc_id", F.concat(F.lit(" "), joined, F.lit(" ")).alias("p"))
    rows = rows.withColumn("n_words", F.when(F.col("p") == "  ", F.lit(0)).otherwise(_blanks(F.col("p")) - 1).cast("long"))
    has = {label: F.contains("p", F.lit(f" {phrase} ")) for label, phrase in (("apache", "apache license"), ("gpl", "general public license"), ("mit", "mit license"))}
    any_base = has["apache"] | has["gpl"] | has["mit"]
    rows = rows.withColumn("base", F.when(any_base, places(F.col("p"), F.lit(BASE))).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    rows = rows.withColumn("base_labels", F.filter(F.array(*(F.when(h, F.lit(label)) for label, h in has.items())), lambda x: x.isNotNull()))
    rows = rows.withColumn("hits", F.when(F.col("p").rlike(GATE), _detections(F.col("p"))).otherwise(none))
    rows = rows.withColumn("detections", F.when(F.size("hits") > 0, resolved(F.col("hits"))).otherwise(none))
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda x: x["label"])))
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "base", "base_labels", "detections", labels.alias("labels"), score.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    starts = F.transform("base", lambda x: x["start"])
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
