"""License scan by ordered signature rules.

A text becomes words (A-Z lower-cased), joined by single blanks, so line breaks,
comment marks and punctuation don't matter.  Each rule is a regular expression
over that form with a label, a rank in the order and a confidence.  Rules are
gated: one is only tried if each of its groups of keywords has a word in the
text, so a text without such words is never searched.

Rules come from hand-written names of licences (``NAMES``) in four forms of use
(identifier tag, grant, heading with a body, mere name), and from sentences of
licence bodies (``BODIES``).  Detections overlap, and are settled by order: one
that lies within another of the same or an earlier rank goes (of equal
intervals the earlier rule stays), so the name inside a grant or the general name inside
one with its version isn't reported beside it.  Detections that overlap in part both stay.

Base phrases (``PHRASES``) are counted at all their places and their labels
always stay.

Rows: a null text counts as empty, which has no words, no labels and score 0;
very long texts are searched whole, in linear time; repeated rows are scanned each; only
the id and the text are read, so other columns can't clash; no step groups rows,
so no key is hot.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .importance import words_of

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_L = "(?:licen[cs]e|lizenz|licence)"
_V = "(?:v|version )?"

#: Names of licences: label, expression over words, keywords of which one must be there, and those of identifier tags.
NAMES: list[tuple[str, str, str]] = [
    # permissive
    ("mit", rf"(?:the )?(?:mit|expat)(?: x11)? {_L}|mit x11|licence mit|mit lizenz", "mit expat"),
    ("mit-0", rf"mit no attribution(?: {_L})?", "mit"),
    ("apache-1", rf"apache(?: software)? {_L} {_V}1(?: [01])?", "apache"),
    ("apache-2", rf"apache(?: software)? {_L}(?: {_V}2(?: 0)?)?|apache 2(?: 0)? {_L}|apache2|asl 2 0", "apache apache2 asl"),
    ("bsd-0", rf"(?:zero clause|0 clause|0bsd) ?(?:bsd )?{_L}|0bsd", "zero 0 0bsd"),
    ("bsd-1", rf"(?:1|one) clause bsd(?: {_L})?|bsd 1 clause(?: {_L})?", "bsd"),
    ("bsd-2", rf"(?:(?:2|two) clause|simplified|freebsd) bsd(?: {_L})?|bsd 2 clause(?: {_L})?", "bsd"),
    ("bsd-3", rf"(?:(?:3|three) clause|new|modified|revised) bsd(?: {_L})?|bsd 3 clause(?: {_L})?", "bsd"),
    ("bsd-4", rf"(?:(?:4|four) clause|original|old) bsd(?: {_L})?|bsd 4 clause(?: {_L})?", "bsd"),
    ("bsd", rf"(?:berkeley software distribution|bsd(?: style)?) {_L}", "berkeley bsd"),
    ("isc", rf"isc {_L}|internet systems consortium {_L}", "isc consortium"),
    ("zlib", rf"zlib(?: libpng)? {_L}", "zlib"),
    ("libpng", rf"(?:lib)?png(?: reference library)? {_L}", "png libpng"),
    ("boost-1", rf"boost(?: software)? {_L}(?: {_V}1(?: 0)?)?", "boost"),
    ("python-2", rf"(?:python software foundation|psf|python) {_L}(?: {_V}2(?: 0)?)?", "python psf"),
    ("php-3", rf"php {_L}(?: {_V}3(?: 0| 01)?)?", "php"),
    ("ruby", rf"ruby {_L}", "ruby"),
    ("postgresql", rf"postgresql {_L}", "postgresql"),
    ("openssl", rf"openssl {_L}|ssleay {_L}", "openssl ssleay"),
    ("curl", rf"curl {_L}", "curl"),
    ("ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa"),
    ("unicode", rf"unicode(?: inc)? {_L}(?: {_V}3(?: 0)?)?|unicode inc {_L} agreement", "unicode"),
    ("wtfpl", rf"do what the f\w+ you want(?: to)?(?: public {_L})?|wtfpl", "wtfpl what"),
    ("unlicense", r"the unlicense|unlicense org|unlicensed? under the unlicense", "unlicense"),
    ("beerware", rf"beer ?ware {_L}|beerware", "beerware beer"),
    ("jquery", rf"jquery {_L}", "jquery"),
    ("afl-3", rf"academic free {_L}(?: {_V}[123](?: [0-9])?)?", "academic"),
    ("artistic-1", rf"artistic {_L} {_V}1(?: 0)?", "artistic"),
    ("artistic-2", rf"artistic {_L}(?: {_V}2(?: 0)?)?", "artistic"),
    ("blueoak-1", rf"blue oak model {_L}(?: {_V}1(?: 0 0)?)?", "oak"),
    ("mulan-2", rf"mulan (?:psl|permissive software {_L})(?: {_V}[12])?", "mulan"),
    ("upl-1", rf"universal permissive {_L}(?: {_V}1(?: 0)?)?", "universal"),
    ("fair", rf"fair {_L}", "fair"),
    ("vim", rf"vim {_L}", "vim"),
    ("w3c", rf"w3c(?: software)?(?: and document)?(?: notice and)? {_L}", "w3c"),
    ("x11", rf"x11 {_L}|x consortium {_L}", "x11 consortium"),
    ("xnet", rf"x net {_L}", "net"),
    ("zope-2", rf"zope public {_L}(?: {_V}[12](?: [01])?)?", "zope"),
    ("hpnd", rf"historical permission notice and disclaimer", "historical"),
    ("tcl", rf"tcl tk {_L}|tcl {_L}", "tcl"),
    ("intel", rf"intel open source {_L}", "intel"),
    ("naumen", rf"naumen public {_L}", "naumen"),
    ("eudatagrid", rf"eu datagrid software {_L}", "datagrid"),
    # weak copyleft
    ("lgpl-2", rf"(?:gnu )?(?:lesser|library) general public {_L} {_V}2(?: 0)?|lgpl ?{_V}2(?: 0)?|lgplv2", "lesser library lgpl lgplv2"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lesser|library) general public {_L}(?: as published by the free software foundation either)? {_V}2 1|lgpl ?{_V}2 1|lgplv2 1", "lesser library lgpl lgplv2"),
    ("lgpl-3", rf"(?:gnu )?lesser general public {_L}(?: as published by the free software foundation either)? {_V}3(?: 0)?|lgpl ?{_V}3(?: 0)?|lgplv3", "lesser lgpl lgplv3"),
    ("lgpl", rf"(?:gnu )?(?:lesser|library) general public {_L}|(?:gnu )?lgpl", "lesser library lgpl"),
    ("mpl-1", rf"mozilla public {_L} {_V}1(?: [01])?|mpl ?{_V}1(?: [01])?", "mozilla mpl"),
    ("mpl-2", rf"mozilla public {_L}(?: {_V}2(?: 0)?)?|mpl ?{_V}2(?: 0)?|mplv2", "mozilla mpl mplv2"),
    ("epl-1", rf"eclipse public {_L} {_V}1(?: 0)?|epl {_V}1(?: 0)?", "eclipse epl"),
    ("epl-2", rf"eclipse public {_L}(?: {_V}2(?: 0)?)?|epl {_V}2(?: 0)?", "eclipse epl"),
    ("edl-1", rf"eclipse distribution {_L}(?: {_V}1(?: 0)?)?", "eclipse"),
    ("cddl-1", rf"common development and distribution {_L}(?: {_V}1(?: [01])?)?|cddl(?: {_V}1(?: [01])?)?", "cddl distribution"),
    ("cpl-1", rf"common public {_L}(?: {_V}1(?: 0)?)?", "common"),
    ("cpal-1", rf"common public attribution {_L}(?: {_V}1(?: 0)?)?", "attribution"),
    ("ipl-1", rf"ibm public {_L}(?: {_V}1(?: 0)?)?", "ibm"),
    ("apsl-2", rf"apple public source {_L}(?: {_V}[12](?: [012])?)?", "apple"),
    ("ms-pl", rf"microsoft public {_L}|ms pl", "microsoft ms"),
    ("ms-rl", rf"microsoft reciprocal {_L}|ms rl", "microsoft ms"),
    ("sissl", rf"sun industry standards source {_L}", "sun"),
    ("qpl-1", rf"q public {_L}(?: {_V}1(?: 0)?)?", "q"),
    ("nokia", rf"nokia open source {_L}", "nokia"),
    ("erlang", rf"erlang public {_L}", "erlang"),
    ("eupl-1.2", rf"european union public {_L}(?: {_V}1(?: [012])?)?|eupl(?: {_V}1(?: [012])?)?", "european eupl"),
    ("cecill", rf"cecill(?: [abc12])?(?: [01])?(?: free software)?(?: {_L})?", "cecill"),
    ("ofl-1.1", rf"sil open font {_L}(?: {_V}1(?: [01])?)?|open font {_L}(?: {_V}1(?: [01])?)?|ofl 1 1", "font ofl"),
    # strong copyleft
    ("agpl-3", rf"(?:gnu )?affero general public {_L}(?: as published by the free software foundation either)?(?: {_V}3(?: 0)?)?|agpl ?(?:{_V}3(?: 0)?)?|agplv3", "affero agpl agplv3"),
    ("gpl-1", rf"gnu general public {_L} {_V}1(?: 0)?|gpl {_V}1(?: 0)?|gplv1", "gnu gpl gplv1"),
    ("gpl-2", rf"(?:gnu )?general public {_L}(?: as published by the free software foundation either)? {_V}2(?: 0)?|(?:gnu )?gpl ?{_V}2(?: 0)?|gplv2", "general gpl gplv2"),
    ("gpl-3", rf"(?:gnu )?general public {_L}(?: as published by the free software foundation either)? {_V}3(?: 0)?|(?:gnu )?gpl ?{_V}3(?: 0)?|gplv3", "general gpl gplv3"),
    ("gpl", rf"gnu general public {_L}|gnu gpl|gpl {_L}", "gnu gpl"),
    ("gfdl", rf"(?:gnu )?free documentation {_L}(?: {_V}1(?: [123])?)?|gfdl(?: {_V}1(?: [123])?)?", "documentation gfdl"),
    ("osl-3", rf"open software {_L}(?: {_V}[123](?: [01])?)?", "open"),
    ("sleepycat", rf"sleepycat {_L}", "sleepycat"),
    ("watcom-1", rf"sybase open watcom public {_L}", "watcom"),
    ("rpl-1.5", rf"reciprocal public {_L}(?: {_V}1(?: 5)?)?", "reciprocal"),
    ("parity", rf"parity public {_L}", "parity"),
    # source available
    ("sspl-1", rf"server side public {_L}(?: {_V}1)?|sspl", "side sspl"),
    ("busl-1.1", rf"business source {_L}(?: {_V}1 1)?|bsl 1 1|busl 1 1", "business bsl busl"),
    ("elastic-2", rf"elastic {_L}(?: {_V}2(?: 0)?)?", "elastic"),
    ("commons-clause", rf"commons clause(?: {_L} condition)?(?: {_V}1(?: 0)?)?", "commons"),
    ("polyform", rf"polyform (?:noncommercial|small business|shield|strict|internal use|perimeter|free trial)(?: {_L})?(?: 1 0 0)?", "polyform"),
    ("confluent", rf"confluent community {_L}", "confluent"),
    ("redis", rf"redis source available {_L}", "redis"),
    ("hippocratic", rf"hippocratic {_L}", "hippocratic"),
    ("json", rf"json {_L}", "json"),
    ("openrail", rf"(?:bigscience )?(?:bloom )?rail {_L}|(?:creativeml )?open ?rail(?: m| s)?(?: {_L})?|openrail", "rail openrail"),
    ("llama", rf"llama(?: [23])? community {_L}", "llama"),
    # content
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "cc commons"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike", "cc commons"),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial", "cc commons"),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv(?:ative)?s?(?: works)?", "cc commons"),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike", "cc commons"),
    ("cc-by", r"cc by(?: [1-4] [05])?|creative commons attribution", "cc commons"),
    ("cc0-1", rf"cc0(?: 1 0)?(?: universal)?|cc zero(?: 1 0)?|creative commons zero(?: {_V}1 0)?(?: universal)?", "cc0 zero"),
    ("cc-pdm", r"public domain mark(?: 1 0)?", "domain"),
    ("cc", rf"creative commons {_L}", "commons"),
    ("odbl-1", rf"open database {_L}(?: {_V}1(?: 0)?)?|odbl(?: 1 0)?", "database odbl"),
    ("odc-by-1", rf"open data commons attribution {_L}|odc by(?: 1 0)?", "commons odc"),
    ("pddl-1", rf"public domain dedication and {_L}|pddl(?: 1 0)?", "dedication pddl"),
    ("cdla-permissive", rf"community data {_L} agreement permissive(?: {_V}[12](?: 0)?)?|cdla permissive(?: [12] 0)?", "community cdla"),
    ("cdla-sharing", rf"community data {_L} agreement sharing(?: {_V}1(?: 0)?)?|cdla sharing(?: 1 0)?", "community cdla"),
    ("ogl-3", rf"open government {_L}(?: {_V}[123](?: 0)?)?|ogl(?: uk)? 3 0", "government ogl"),
    ("etalab-2", rf"licence ouverte(?: open licence)?(?: etalab)?|etalab(?: 2 0)?", "ouverte etalab"),
    ("dl-de", r"datenlizenz deutschland(?: namensnennung)?(?: zero)?|dl de (?:by|zero)(?: 2 0)?", "datenlizenz dl"),
    ("fal-1.3", rf"free art {_L}(?: 1 3)?|licence art libre", "art"),
]

#: Sentences of licence bodies and notices: label, expression over words, keywords.
BODIES: list[tuple[str, str, str]] = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby"),
    ("mit", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd-3", r"neither the names? of (?:\S+ ){1,16}?nor the names of its contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented", "altered"),
    ("apache-2", r"you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?", "compliance"),
    ("apache-2", r"(?:http |https )?(?:www )?apache org licenses license 2 0", "apache"),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("agpl-3", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute"),
    ("gpl", r"(?:https? )?(?:www )?gnu org licenses gpl(?: [123](?: 0)?)?(?: html| txt)?", "gnu"),
    ("lgpl", r"(?:https? )?(?:www )?gnu org licenses lgpl(?: [23](?: [01])?)?(?: html| txt)?", "gnu"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license(?: v(?:ersion)? ?2 0)?", "mozilla"),
    ("mpl-2", r"(?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0", "mozilla"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", r"(?:(?:is|are|been|was|were|hereby) )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain", "domain"),
    ("public-domain", r"no rights reserved", "rights"),
    ("boost-1", r"distributed under the boost software license version 1 0(?: see accompanying file)?", "boost"),
    ("wtfpl", r"you just do what the f\w+ you want to", "just"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "beer"),
    ("json", r"the software shall be used for good not evil", "evil"),
    ("cc-by-nc-nd", r"(?:https? )?creativecommons org licenses by nc nd(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nc-sa", r"(?:https? )?creativecommons org licenses by nc sa(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nc", r"(?:https? )?creativecommons org licenses by nc(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-nd", r"(?:https? )?creativecommons org licenses by nd(?: [1-4] [05])?", "creativecommons"),
    ("cc-by-sa", r"(?:https? )?creativecommons org licenses by sa(?: [1-4] [05])?", "creativecommons"),
    ("cc-by", r"(?:https? )?creativecommons org licenses by(?: [1-4] [05])?", "creativecommons"),
    ("cc0-1", r"(?:https? )?creativecommons org publicdomain zero(?: 1 0)?", "creativecommons"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font"),
    ("proprietary", r"all rights reserved|alle rechte vorbehalten|tous droits r.serv.s|todos los derechos reservados|tutti i diritti riservati", "reserved vorbehalten droits derechos diritti"),
    ("proprietary", r"(?:unauthori[sz]ed copying|reproduction|redistribution)(?: of this (?:file|document|work))?(?: via any medium)? is strictly prohibited", "strictly"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", "proprietary"),
    ("proprietary", r"may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed|transmitted))* without (?:the )?(?:prior |express )*(?:written )?permission", "permission"),
    ("non-commercial", r"for (?:personal and )?non ?commercial (?:use|purposes) only|not for commercial use", "commercial noncommercial"),
]

#: How a name is used: rank in the order, confidence, expression around the name, keywords beside the name's.
FORMS: list[tuple[str, int, float, str, str]] = [
    ("tag", 0, 0.99, r"spdx license identifier (?:{})(?: or later| only)?", "spdx"),
    ("grant", 1, 0.95, r"(?:(?:is|are|be|been|was|were) )?(?:licen[cs]ed|released|distributed|published|available|provided|made available|redistribute(?:d)?|lizenziert|veröffentlicht)(?: \S+){{0,3}}? (?:under|unter|sous)(?: the terms of| den bedingungen)?(?: the| a| an| der| la)?(?: terms of the)? (?:{})(?: {_L})?(?: or later| or any later version| only)?".replace("{_L}", _L), "under unter sous"),
    ("head", 2, 0.8, r"(?:{}) (?:copyright(?: c)?|terms and conditions)", "copyright terms"),
    ("name", 3, 0.6, r"(?:{})", ""),
]
#: Rank and confidence of sentences of bodies.
_BODY = (1, 0.9)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    rank: int
    confidence: float
    pattern: re.Pattern[str]
    keywords: tuple[frozenset[str], ...]


def _rule(name: str, label: str, rank: int, confidence: float, pattern: str, *keywords: str) -> Rule:
    return Rule(name, label, rank, confidence, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), tuple(frozenset(k.split()) for k in keywords if k))


def rules() -> list[Rule]:
    """All rules in their order: by rank, then as they are written."""
    made = [_rule(f"{label}/body{i}", label, *_BODY, pattern, words) for i, (label, pattern, words) in enumerate(BODIES)]
    for label, pattern, words in NAMES:
        for form, rank, confidence, around, more in FORMS:
            made.append(_rule(f"{label}/{form}", label, rank, confidence, around.format(pattern), words, more))
    return sorted(made, key=lambda r: r.rank)


class Scanner:
    """Rules by their keywords."""

    def __init__(self, known: list[Rule]):
        self.rules = known
        self.words = frozenset(w for r in known for group in r.keywords for w in group)

    def candidates(self, words: set[str]) -> list[tuple[int, Rule]]:
        there = self.words & words
        return [(i, r) for i, r in enumerate(self.rules) if all(group & there for group in r.keywords)] if there else []

    def detect(self, candidates: list[tuple[int, Rule]], joined: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in characters of joined, after suppression, by place."""
        found = []
        for i, rule in candidates:
            found += [(m.start(), m.end(), i) for m in rule.pattern.finditer(joined)]
        return settle(found, [r.rank for r in self.rules])


def settle(found: list[tuple[int, int, int]], rank: list[int]) -> list[tuple[int, int, int]]:
    """Detections that don't lie within another of the same or an earlier rank; of equal intervals the earliest rule stays.

    One pass from left to right, wider intervals first, with the furthest end of each rank so far.
    """
    furthest: dict[int, int] = {}
    kept = []
    for start, end, i in sorted(found, key=lambda d: (d[0], -d[1], d[2])):
        if not any(e >= end for r, e in furthest.items() if r <= rank[i]):
            kept.append((start, end, i))
        furthest[rank[i]] = max(end, furthest.get(rank[i], 0))
    return kept


def base(joined: str) -> list[tuple[int, str]]:
    """(character, label) of all places of base phrases."""
    padded = f" {joined} "
    found = []
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            found.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return found


_DETECTION = pa.struct([("label", pa.string()), ("rule", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())])
_SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), ("detections", pa.list_(_DETECTION))])


def scan_text(text: str | None, scanner: Scanner) -> tuple[int, list[dict], list[dict]]:
    """Number of words, base places, detections of one text."""
    words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
    different = set(words)
    rules_ = scanner.candidates(different)
    if not rules_ and not any(different.issuperset(p.split()) for p in PHRASES):
        return len(words), [], []
    joined = " ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    at = lambda c: bisect_right(starts, c) - 1
    found = [{"label": (r := scanner.rules[i]).label, "rule": r.name, "first": at(s), "last": at(e - 1), "confidence": r.confidence} for s, e, i in scanner.detect(rules_, joined)]
    return len(words), [{"word": at(c), "label": label} for c, label in base(joined)], found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (places of base phrases), detections (label, rule, first and last word, confidence) of each document."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = common.worker_cache("licenses", lambda: Scanner(rules()))
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                found = [scan_text(x, scanner) for x in part.column(1).to_pylist()]
                n, places, detections = (list(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(places, _SCAN.field("base").type), pa.array(detections, _SCAN.field("detections").type)], schema=_SCAN)

    schema = "doc_id bigint, n_words bigint, base array<struct<word:bigint,label:string>>, detections array<struct<label:string,rule:string,first:bigint,last:bigint,confidence:double>>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def labelled(scanned: DataFrame) -> DataFrame:
    """Labels, places and the score of scanned documents: 1 less the product of what each label's best detection leaves open."""
    listed = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    words, names = F.transform("base", lambda x: x["word"]), F.transform("base", lambda x: x["label"])
    found = F.transform("detections", lambda x: x["label"])
    best = lambda label: F.array_max(F.transform(F.filter("detections", lambda d: d["label"] == label), lambda d: d["confidence"]))
    # a base phrase is a detection of confidence 0.95, whatever rules say of its place
    left = F.aggregate(F.array_distinct(F.concat(names, found)), F.lit(1.0), lambda s, x: s * (1 - F.greatest(F.coalesce(best(x), F.lit(0.0)), F.when(F.array_contains(names, x), 0.95).otherwise(0.0))))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        listed(names).alias("base_labels"), listed(F.concat(names, found)).alias("labels"), F.round(1 - left, 9).alias("score"), "detections",
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all documents."""
    return labelled(scan(common.table(spark, sf_dir, "documents"))).withColumn("n_detections", F.size("detections")).drop("detections")
