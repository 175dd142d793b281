"""Licence detection by ordered signature rules.

Rules are regular expressions over the lower-cased words of a text: names of licences and the clauses of their own
texts (``license_clauses``). A rule holds one anchor word; only texts with an
anchor are cut into words, only the words around an anchor are looked at, and there only rules whose own keyword stands
nearby are tried. A detection inside another one of the same or a higher priority is suppressed. All expressions are
built-in functions on the row, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_clauses import clauses, keyword
from .storage import carried, own, packed, unpacked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words on each side of an anchor that a rule may cover.
REACH = 24
# Anchors whose detections are compared at once.
CHUNK = 32

# Fixed phrases and labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over words with single spaces; its anchor has the mark ``>``. Priority 1 is the highest."""

    label: str
    pattern: str
    anchor: str
    keyword: str
    priority: int
    confidence: float
    base: str = ""


LICENSE = "(?:>license|>licence)"
# Names of licences as label, keyword and pattern, the anchor marked; {v} stands for the versions given after it.
NAMES = [
    ("MIT", "mit", f"mit {LICENSE}", ()),
    ("MIT", "expat", f"expat {LICENSE}", ()),
    ("X11", "x11", f"x11 {LICENSE}", ()),
    ("ISC", "isc", f"isc {LICENSE}", ()),
    ("Zlib", "zlib", f"zlib(?: libpng)? {LICENSE}", ()),
    ("Unlicense", "unlicense", ">unlicense", ()),
    ("WTFPL", "wtfpl", ">wtfpl", ()),
    ("WTFPL", "fuck", f"do what the fuck you want to public {LICENSE}", ()),
    ("BSL-1.0", "boost", f"boost software {LICENSE}(?: (?:version )?1 0)?", ()),
    ("NCSA", "ncsa", f"(?:uiuc|ncsa)(?: open source)? {LICENSE}", ()),
    ("PostgreSQL", "postgresql", f"postgresql {LICENSE}", ()),
    ("OpenSSL", "openssl", f"openssl {LICENSE}", ()),
    ("Ruby", "ruby", f"ruby {LICENSE}", ()),
    ("Vim", "vim", f"vim {LICENSE}", ()),
    ("QPL-1.0", "q", f"q public {LICENSE}", ()),
    ("Sleepycat", "sleepycat", f"sleepycat {LICENSE}", ()),
    ("PSF-2.0", "python", f"python software foundation {LICENSE}", ()),
    ("Beerware", "beer", f"beer ?ware {LICENSE}", ()),
    ("0BSD", "bsd", "(?:0|zero clause) >bsd", ()),
    ("BSD-1-Clause", "bsd", "(?:1|one) clause >bsd|>bsd 1 clause", ()),
    ("BSD-2-Clause", "bsd", "(?:2|two) clause >bsd|(?:simplified|freebsd) >bsd|>bsd (?:2|two) clause", ()),
    ("BSD-3-Clause", "bsd", "(?:3|three) clause >bsd|(?:new|revised|modified) >bsd|>bsd (?:3|three) clause", ()),
    ("BSD-4-Clause", "bsd", "(?:4|four) clause >bsd|(?:original|old) >bsd|>bsd (?:4|four) clause", ()),
    ("BSD", "bsd", ">bsd licen[sc]e", ()),
    ("GPL", "gnu", f"gnu general public {LICENSE}", ()),
    ("GPL-{v}.0", "gnu", f"gnu general public {LICENSE}(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{{v}}", ("1", "2", "3")),
    ("GPL-{v}.0", "gpl", ">gpl v?(?:ersion )?{v}", ("1", "2", "3")),
    ("GPL-{v}.0", "gplv{v}", ">gplv{v}", ("2", "3")),
    ("GPL", "gpl", "gnu >gpl", ()),
    ("LGPL", "lesser", f"gnu (?:lesser|library) general public {LICENSE}", ()),
    ("LGPL-{v}", "general", f"gnu (?:lesser|library) general public {LICENSE} v(?:ersion)? ?{{v}}", ("2 0", "2 1", "3 0", "3")),
    ("LGPL-{v}", "lgpl", ">lgpl v?(?:ersion )?{v}", ("2 0", "2 1", "3")),
    ("AGPL-{v}.0", "affero", f"(?:gnu )?affero general public {LICENSE}(?: v(?:ersion)? ?{{v}})?", ("3",)),
    ("AGPL-{v}.0", "agpl", ">agpl(?: v?{v})?", ("3",)),
    ("GFDL-{v}", "documentation", f"gnu free documentation {LICENSE} v(?:ersion)? ?{{v}}", ("1 1", "1 2", "1 3")),
    ("Apache", "apache", f"apache(?: software)? {LICENSE}", ()),
    ("Apache-{v}", "apache", f"apache(?: software)? {LICENSE} v(?:ersion)? ?{{v}}", ("1 0", "1 1", "2 0")),
    ("Apache-{v}", "apache", f"apache {{v}} {LICENSE}", ("1 1", "2 0")),
    ("MPL-{v}", "mozilla", f"mozilla public {LICENSE} v?(?:ersion )?{{v}}", ("1 0", "1 1", "2 0")),
    ("MPL-{v}", "mpl", ">mpl v?(?:ersion )?{v}", ("1 0", "1 1", "2 0")),
    ("EPL-{v}", "eclipse", f"eclipse public {LICENSE} v?(?:ersion )?{{v}}", ("1 0", "2 0")),
    ("EPL-{v}", "epl", ">epl v?(?:ersion )?{v}", ("1 0", "2 0")),
    ("EUPL-{v}", "european", f"european union public {LICENSE} v?(?:ersion )?{{v}}", ("1 1", "1 2")),
    ("CDDL-{v}", "common", f"common development and distribution {LICENSE} v?(?:ersion )?{{v}}", ("1 0", "1 1")),
    ("CPL-1.0", "common", f"common public {LICENSE}", ()),
    ("IPL-1.0", "ibm", f"ibm public {LICENSE}", ()),
    ("OFL-1.1", "font", f"(?:sil )?open font {LICENSE}", ()),
    ("Artistic-{v}", "artistic", f"artistic {LICENSE}(?: v?(?:ersion )?{{v}})", ("1 0", "2 0")),
    ("AFL-{v}", "academic", f"academic free {LICENSE}(?: v?(?:ersion )?{{v}})", ("2 1", "3 0")),
    ("OSL-{v}", "open", f"open software {LICENSE}(?: v?(?:ersion )?{{v}})", ("2 1", "3 0")),
    ("PHP-{v}", "php", f"php {LICENSE}(?: v?(?:ersion )?{{v}})", ("3 0", "3 01")),
    ("LPPL-1.3", "latex", f"latex project public {LICENSE}", ()),
    ("MS-PL", "microsoft", f"microsoft public {LICENSE}", ()),
    ("MS-RL", "microsoft", f"microsoft reciprocal {LICENSE}", ()),
    ("SSPL-1.0", "server", f"server side public {LICENSE}", ()),
    ("BUSL-1.1", "business", f"business source {LICENSE}", ()),
    ("Elastic-2.0", "elastic", f"elastic {LICENSE}(?: 2 0)?", ()),
    ("ODbL-1.0", "database", f"open database {LICENSE}", ()),
    ("ODC-By-1.0", "attribution", f"open data commons attribution {LICENSE}", ()),
    ("PDDL-1.0", "dedication", f"public domain dedication and {LICENSE}", ()),
    ("CC0-1.0", "cc0", ">cc0(?: 1 0)?", ()),
    ("CC-BY", "cc", ">cc by", ()),
    ("CC-BY-SA", "cc", ">cc by sa", ()),
    ("CC-BY-ND", "cc", ">cc by nd", ()),
    ("CC-BY-NC", "cc", ">cc by nc", ()),
    ("CC-BY-NC-SA", "cc", ">cc by nc sa", ()),
    ("CC-BY-NC-ND", "cc", ">cc by nc nd", ()),
    ("CC-BY-{v}", "cc", ">cc by {v}", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("CC-BY-SA-{v}", "cc", ">cc by sa {v}", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("CC-BY-ND-{v}", "cc", ">cc by nd {v}", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("CC-BY-NC-{v}", "cc", ">cc by nc {v}", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("CC-BY-NC-SA-{v}", "cc", ">cc by nc sa {v}", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("CC-BY-NC-ND-{v}", "cc", ">cc by nc nd {v}", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("CC-BY", "commons", "creative >commons attribution", ()),
    ("CC-BY-{v}", "commons", "creative >commons attribution {v}", ("2 0", "3 0", "4 0")),
    ("CC-BY-SA-{v}", "commons", "creative >commons attribution share ?alike {v}", ("2 0", "3 0", "4 0")),
    ("CC-BY-NC-{v}", "commons", "creative >commons attribution non ?commercial {v}", ("2 0", "3 0", "4 0")),
    ("CC-BY-ND-{v}", "commons", "creative >commons attribution no ?deriv(?:ative)?s {v}", ("2 0", "3 0", "4 0")),
    ("public-domain", "public", "(?:in|into|to) the public >domain", ()),
    ("proprietary", "all", "all rights >reserved", ()),
]
# A named licence, granted in words.
GRANT = "(?:licensed|licenced|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
LATER = "(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?"


def rules() -> list[Rule]:
    """All rules in order: by name, granted name, name with later versions, identifier line; clauses; the base phrases."""
    out = []
    for label, word, pattern, versions in NAMES:
        for v in versions or ("",):
            name = label.replace("{v}", v.replace(" ", "."))
            key, body = word.replace("{v}", v), pattern.replace("{v}", v)
            exact = bool(v) or not any(x[0].startswith(label) and x[3] for x in NAMES)
            out.append(Rule(name, body, "", key, 3, 0.8 if exact else 0.6))
            out.append(Rule(name, f"{GRANT}(?:{body})", "", key, 2, 0.95 if exact else 0.75))
            if v and label.split("-")[0] in ("GPL", "LGPL", "AGPL", "GFDL", "MPL", "EPL"):
                out.append(Rule(f"{name}-or-later", f"(?:{GRANT})?(?:{body}){LATER}", "", key, 1, 1.0))
            if "-" in name or label in ("MIT", "ISC", "Zlib", "Unlicense"):
                spelled = name.lower().replace("-", " ").replace(".", " ")
                out.append(Rule(name, f">spdx license identifier {spelled}", "spdx", "identifier", 1, 1.0))
    out.append(Rule("license-notice", "(?:>licensed|>licenced) under", "", "under", 5, 0.3))
    out += [Rule(name, words, "", keyword(words), priority, sure) for name, words, priority, sure in clauses()]
    for phrase, label in BASE_PHRASES.items():
        last = phrase.split()[-1]
        marked = ">cc by" if phrase == "cc by" else phrase.removesuffix(last) + ">" + last
        out.append(Rule(label, marked, "", last if phrase == "cc by" else phrase.split()[0], 4, 0.5, base=label))
    return list(dict.fromkeys(out))


def by_anchor(of: list[Rule]) -> dict[str, list[dict]]:
    """Rules by anchor word; a rule with a choice of anchors stands under each of them."""
    import re

    found: dict[str, list[dict]] = {}
    for rule in of:
        for anchor in sorted(set(re.findall(r">(\w+)", rule.pattern))):
            entry = asdict(rule) | {"anchor": anchor, "pattern": f"(?:^|(?<= ))(?:{rule.pattern})(?= |$)"}
            found.setdefault(anchor, []).append(entry)
    return found


ENTRY = "label string, pattern string, anchor string, keyword string, priority int, confidence double, base string"


def _detections(words: Column, table: dict[str, list[dict]]) -> Column:
    """Per anchor of a text, in order, the array of detections there."""
    rules_of = F.from_json(F.lit(json.dumps(table)), f"map<string, array<struct<{_ddl()}>>>")
    anchors = list(table)

    def at(w: Column) -> Column:
        places = F.filter(
            F.transform(w, lambda x, i: F.when(x.isin(anchors), i.cast("int"))), lambda i: i.isNotNull()
        )

        def found(p: Column) -> Column:
            before = F.slice(w, F.greatest(p - REACH, F.lit(0)) + 1, F.least(p, F.lit(REACH)))
            after = F.slice(w, p + 2, REACH)
            anchor = F.get(w, p)
            text = F.concat_ws(" ", before, F.array(F.concat(F.lit(">"), anchor)), after)

            def tried(t: Column) -> Column:
                near = F.filter(rules_of[anchor], lambda r: F.contains(t, r["keyword"]))
                hits = F.transform(near, lambda r: F.struct(r.alias("r"), F.call_function("regexp_extract", t, r["pattern"], F.lit(0)).alias("m")))
                real = F.filter(hits, lambda h: F.length(h["m"]) > 0)

                def span(h: Column) -> Column:
                    ahead = F.size(F.split(F.substring_index(h["m"], ">", 1), " ")) - 1
                    start = (p - ahead).cast("long")
                    return F.struct(
                        start.alias("start"),
                        (start + F.size(F.split(h["m"], " "))).alias("end"),
                        h["r"]["label"].alias("label"),
                        h["r"]["priority"].alias("priority"),
                        h["r"]["confidence"].alias("confidence"),
                        h["r"]["base"].alias("base"),
                        F.regexp_replace(h["m"], ">", "").alias("words"),
                    )

                return F.transform(real, span)

            return F.transform(F.array(text), tried)[0]

        return F.transform(places, found)

    return F.transform(F.array(words), at)[0]


def _ddl() -> str:
    return ENTRY.replace(" string", ": string").replace(" int", ": int").replace(" double", ": double")


def _surviving(found: Column) -> Column:
    """Detections that no other one of the same or a higher priority contains.

    A detection reaches over at most 2 * REACH + 1 words and so over as many anchors; anchors are taken in chunks and
    compared with those around them, which keeps the work in proportion to the text.
    """
    margin = 2 * REACH + 1

    def inside(d: Column, e: Column) -> Column:
        wider = (e["start"] < d["start"]) | (e["end"] > d["end"])
        better = (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & wider)
        return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & better

    def all_of(f: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.size(f) - 1, F.lit(0)), F.lit(CHUNK))

        def kept(k: Column) -> Column:
            first = F.greatest(k - margin, F.lit(0))
            near = F.flatten(F.slice(f, first + 1, k + CHUNK + margin - first))
            mine = F.flatten(F.slice(f, k + 1, CHUNK))
            return F.transform(
                F.array(near), lambda n: F.filter(mine, lambda d: ~F.exists(n, lambda e: inside(d, e)))
            )[0]

        return F.flatten(F.transform(chunks, kept))

    return F.transform(F.array(found), all_of)[0]


def scan(docs: DataFrame, text: str = "text", of: list[Rule] | None = None) -> DataFrame:
    """All rows of ``docs`` with the licences found in the whole text.

    Adds ``n_words``; ``places``, all places of the base phrases; ``detections``, the surviving detections with their
    span in words, label, priority, confidence and words; ``base_labels`` and ``labels``, sorted; ``score``, the
    highest confidence. NULL text counts as empty and has no detection: empty arrays and score 0. Repeated rows each
    get their result. Equal detections of one label are one. Input columns of the added names are replaced. An empty
    table gives an empty table.
    """
    added = ["n_words", "places", "detections", "base_labels", "labels", "score"]
    columns = carried(docs, added)
    table = by_anchor(of if of is not None else rules())
    whole = F.coalesce(own(text), F.lit(""))
    gate = "(?i)(?<![0-9a-z])(?:" + "|".join(table) + ")(?![0-9a-z])"
    words = F.regexp_extract_all(F.translate(whole, CAPITALS, SMALL), F.lit(f"({WORD})"), F.lit(1))
    none = F.from_json(F.lit("[]"), "array<array<struct<start: bigint, end: bigint, label: string, priority: int, confidence: double, base: string, words: string>>>")
    found = F.when(F.rlike(whole, F.lit(gate)), _detections(words, table)).otherwise(none)
    read = docs.select(
        packed(docs, columns).alias("row"),
        F.regexp_count(whole, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
        found.alias("found"),
    )

    def summed(f: Column) -> Column:
        places = F.filter(F.flatten(f), lambda d: d["base"] != "")
        kept = F.array_distinct(F.filter(_surviving(f), lambda d: d["base"] == ""))
        return F.struct(places.alias("places"), kept.alias("detections"))

    told = read.select("row", "n_words", F.transform(F.array("found"), summed)[0].alias("told"))
    places, kept = F.col("told.places"), F.col("told.detections")
    base_labels = F.array_distinct(F.transform(places, lambda d: d["base"]))
    labels = F.array_union(base_labels, F.transform(kept, lambda d: d["label"]))
    confidence = F.array_max(F.transform(F.concat(places, kept), lambda d: d["confidence"]))
    return told.select(
        *unpacked(columns),
        "n_words",
        places.alias("places"),
        kept.alias("detections"),
        F.sort_array(base_labels).alias("base_labels"),
        F.sort_array(labels).alias("labels"),
        F.coalesce(confidence, F.lit(0.0)).alias("score"),
    )
