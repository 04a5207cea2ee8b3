"""License detection by ordered signature rules.

Every rule is a regular expression over the document's words, lower-cased and joined by
single spaces, with a label, a priority (smaller is stronger) and a keyword that must occur
for the expression to run at all; documents without any rule's keyword are passed over.
Overlapping detections are resolved, containment before priority: first one that lies inside
another is dropped, whatever its priority, and of equal intervals the stronger (then the earlier
rule) stays.  Then, from the strongest priority down, one that partly overlaps a stronger
detection that stays is dropped.  Both are sweeps in order of place, not comparisons in pairs.

All of it is expressions over one row, so nothing is shuffled.  Null texts have no words;
null or repeated ids each give a row.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from oreline.llm.common import ascii_lower, swept

# The phrases and labels of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# No rule can match a document that has none of these.
_GATES = (
    "licen", "spdx", "gpl", "creative commons", " cc ", "public domain", "bsd", "cc0", " fuck ",
    "rights reserved", "hereby granted", "free of charge", "redistribution", "free software",
)
_PLACES = "array<struct<start:bigint,end:bigint>>"


def rules() -> list[tuple[int, str, str, str]]:
    """``(priority, label, keyword, expression)`` in order, built from families.

    In expressions a space stands for the gap between two words.  Priority 0 is a notice or
    grant, 1 a full name or an identifier behind a license tag, 2 a bare short name.
    """
    licen = "licen[sc]e"
    found = [(0, label, phrase, phrase) for phrase, label in BASE.items()]
    granted = "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"
    tag = "spdx license identifier "
    gnu = {"gpl": "general public", "lgpl": "(?:lesser|library) general public", "agpl": "affero general public"}
    for (short, name), version, later in product(gnu.items(), ("1", "2", "2 1", "3"), (True, False)):
        label = f"{short}-{version.replace(' ', '.')}" + ("-or-later" if later else "")
        number = rf"(?:version |v)?{version}" + ("(?: 0)?" if " " not in version else "")
        tail = " (?:or(?: at your option)? (?:any )?later|or newer)(?: version)?" if later else ""
        found += [
            (1, label, "general public" if short != "agpl" else "affero general", f"(?:gnu )?{name} {licen} {number}{tail}"),
            (1, label, "spdx", f"{tag}{short} {number}" + (" or later" if later else "(?: only)?")),
            (2, label, short, f"{short} ?{number}{tail}"),
        ]
    parts = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
    names = {
        "by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial",
    }
    for part, version in product(parts, ("1 0", "2 0", "2 5", "3 0", "4 0", "")):
        label = f"cc-{part.replace(' ', '-')}" + (f"-{version.replace(' ', '.')}" if version else "")
        number = f" {version}" if version else ""
        spelled = " ".join(names[p] for p in part.split())
        found += [
            (1, label, "creative commons", f"creative commons {spelled}(?: international| generic)?{number}"),
            (2, label, f"cc {part}", f"cc {part}{number}"),
        ]
    clauses = {"bsd-2-clause": "2 clause|two clause|simplified|freebsd", "bsd-3-clause": "3 clause|three clause|new|revised|modified", "bsd-4-clause": "4 clause|four clause|original|old"}
    for label, names_of in clauses.items():
        found += [
            (1, label, "bsd", f"(?:{names_of}) bsd {licen}"),
            (1, label, "bsd", f"bsd (?:{names_of}) {licen}"),
            (1, label, "spdx", f"{tag}{label.replace('-', ' ')}"),
        ]
    # Identifier, the words of its name, and where it stands for itself in a short form.
    plain = {
        "mit": f"mit {licen}", "isc": f"isc {licen}", "zlib": f"zlib {licen}", "0bsd": f"zero clause bsd(?: {licen})?",
        "apache-1.1": f"apache (?:software )?{licen}(?: version)? 1 1", "apache-2": f"apache {licen}(?: version)? 2(?: 0)?",
        "mpl-1.1": f"mozilla public {licen}(?: version)? 1 1", "mpl-2.0": f"mozilla public {licen}(?: version)? 2 0",
        "epl-1.0": f"eclipse public {licen}(?: version)? 1 0", "epl-2.0": f"eclipse public {licen}(?: version)? 2 0",
        "cddl-1.0": f"common development and distribution {licen}", "eupl-1.2": f"european union public {licen}",
        "artistic-2.0": f"artistic {licen}(?: version)? 2 0", "bsl-1.0": f"boost software {licen}",
        "python-2.0": f"python software foundation {licen}", "wtfpl": "do what the fuck you want to public",
        "ofl-1.1": f"sil open font {licen}", "odbl-1.0": f"open (?:data commons )?(?:open )?database {licen}",
        "unlicense": "(?:the )?unlicense", "cc0": "(?:creative commons )?cc0", "ms-pl": f"microsoft public {licen}",
        "postgresql": f"postgresql {licen}", "openssl": f"openssl {licen}", "php-3.01": f"php {licen}",
        "gfdl": f"gnu free documentation {licen}", "upl-1.0": f"universal permissive {licen}",
    }
    rare = {"unlicense": "unlicense", "wtfpl": "fuck", "cc0": "cc0"}
    for label, name in plain.items():
        keyword = rare.get(label) or name.split()[0]
        identifier = label.replace("-", " ").replace(".", " ")
        found += [
            (0, label, keyword, f"{granted}(?:{name})"),
            (1, label, keyword, f"(?:{name})"),
            (1, label, "spdx", f"{tag}{identifier}"),
        ]
    public = {
        "public-domain": ("public domain", "(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
        "proprietary": ("rights reserved", "all rights reserved"),
        "mit-text": ("free of charge", "permission is hereby granted free of charge to any person"),
        "isc-text": ("hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        "bsd-text": ("redistribution", "redistribution and use in source and binary forms"),
        "gpl-text": ("free software", "this program is free software you can redistribute it"),
    }
    found += [(0, label, keyword, text) for label, (keyword, text) in public.items()]
    return found


def joined_words(text: Column) -> Column:
    """Lower-cased words with a space before each, and one after the last."""
    blank = F.regexp_replace(
        ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "
    )
    return F.concat(F.lit(" "), F.trim(blank), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _places(words: Column, expression: Column) -> Column:
    """Word intervals (end exclusive) of all matches; a match starts with a space."""
    pattern = F.concat(F.lit(" (?:"), expression, F.lit(")(?= )"))
    values = F.transform(F.regexp_extract_all(words, pattern, F.lit(0)), _spaces)
    gaps = F.transform(F.split(words, pattern, -1), _spaces)
    pairs = F.arrays_zip(values.alias("n"), F.slice(gaps, 1, F.size(values)).alias("gap"))

    def step(state, pair):
        begin = state["at"] + pair["gap"]
        end = begin + pair["n"]
        return {"at": end}, F.array(F.struct(begin.alias("start"), end.alias("end"))), F.lit(True)

    return swept(pairs, {"at": F.lit(0).cast("bigint")}, step, _PLACES)


def _base_places(words: Column, phrase: str) -> Column:
    places = _places(words, F.lit(phrase))
    return F.when(F.contains(words, F.lit(f" {phrase} ")), places).otherwise(F.array().cast(_PLACES))


def _detections(words: Column) -> Column:
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"),
                F.lit(key).alias("keyword"), F.lit(text).alias("text"),
            )
            for i, (p, label, key, text) in enumerate(rules())
        ]
    )
    active = F.filter(table, lambda r: F.contains(words, r["keyword"]))

    def run(rule):
        return F.transform(
            _places(words, rule["text"]),
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"),
            ),
        )

    return F.flatten(F.transform(active, run))


_SWEPT = "array<struct<start:bigint,back:bigint,priority:int,rule:int,label:string>>"


def _resolved(found: Column) -> Column:
    """Sweeps over the detections by start, of which those that start alike by end, longest
    first, then by priority and rule (``back`` is the negative end, for this order)."""
    fields = ("priority", "rule", "label")
    order = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), *[d[f].alias(f) for f in fields]),
        )
    )

    def outer(state, d):
        # Inside, or equal to, an earlier one if that ends at least as late.
        free = -d["back"] > state["end"]
        return {"end": F.greatest(state["end"], -d["back"])}, F.array(d), free

    kept = swept(order, {"end": F.lit(-1).cast("bigint")}, outer, _SWEPT)
    # None lies inside another now, so ends ascend like starts: of the stronger ones only the
    # last before and the first after can overlap.
    for level in sorted({priority for priority, *_ in rules()})[1:]:

        def ahead(state, d, level=level):
            stronger = d["priority"] < level
            beaten = (d["priority"] == level) & (state["end"] > d["start"])
            return {"end": F.when(stronger, -d["back"]).otherwise(state["end"])}, F.array(d), ~beaten

        def behind(state, d, level=level):
            stronger = d["priority"] < level
            beaten = (d["priority"] == level) & (state["start"] < -d["back"])
            return {"start": F.when(stronger, d["start"]).otherwise(state["start"])}, F.array(d), ~beaten

        kept = swept(kept, {"end": F.lit(-1).cast("bigint")}, ahead, _SWEPT)
        kept = F.reverse(swept(F.reverse(kept), {"start": F.lit(2**62)}, behind, _SWEPT))
    return F.transform(
        kept, lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), *[d[f].alias(f) for f in fields])
    )


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_words``, the base phrases' places (``base``: phrase label, start,
    end) and the resolved ``detections`` (start, end, priority, rule, label)."""
    words = F.col("words")
    gate = F.lit(False)
    for key in _GATES:
        gate = gate | F.contains(words, F.lit(key))

    def labelled(phrase, label):
        return F.transform(
            _base_places(words, phrase),
            lambda p: F.struct(F.lit(label).alias("label"), p["start"].alias("start"), p["end"].alias("end")),
        )

    base = F.concat(*[labelled(phrase, label) for phrase, label in BASE.items()])
    none = F.array().cast(
        "array<struct<start:bigint,end:bigint,priority:int,rule:int,label:string>>"
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), joined_words(F.col(text_col)).alias("words"))
    rows = rows.select(
        "doc_id",
        F.when(F.octet_length(words) > 2, _spaces(words) - 1).otherwise(0).alias("n_words"),
        base.alias("base"),
        F.when(gate, _detections(words)).otherwise(none).alias("found"),
    )
    return rows.select("doc_id", "n_words", "base", _resolved(F.col("found")).alias("detections"))


def report(found: DataFrame) -> DataFrame:
    """The places and labels as text.  The score is that of the strongest detection: 1 for a
    notice or grant (the base phrases are such), 0.8 for a name, 0.5 for a short name, else 0."""
    starts = F.transform("base", lambda b: b["start"])
    labels = F.transform("base", lambda b: b["label"])
    every = F.concat(labels, F.transform("detections", lambda d: d["label"]))
    strongest = F.array_min(F.transform("detections", lambda d: d["priority"]))
    score = (
        F.when(F.size("base") > 0, 1.0).when(strongest == 0, 1.0).when(strongest == 1, 0.8)
        .when(strongest == 2, 0.5).otherwise(0.0)
    )
    text = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        text(labels).alias("base_labels"),
        text(every).alias("labels"),
        score.alias("score"),
    )
