"""License scan: ordered signature rules behind a keyword prefilter.

Signatures of license texts and notices are written one by one (SIGNATURES, EXTRA); names are written by family: a table of licenses with their
names, abbreviations and versions, and templates for the ways in which a text says it is licensed (a license line, a plain name, an
SPDX tag). Together they make some hundreds of regexes, each with keywords of which one must occur in the text before the regex is tried, and a
priority: a detection whose span lies within that of one of higher priority, or of equal priority and at least its length, is suppressed (interval
containment), so `Apache License, Version 2.0` leaves `apache-2.0` and not also `apache`. Independently of suppression, the base phrases
give their labels. A reservation of rights is no license and gives `copyright`.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. The score is the highest confidence of what
was found: 1.0 for a license line, header, SPDX tag or URL, 0.8 for a full name, 0.5 for a bare abbreviation, else 0.

Defined results: a null or empty text has no words, no places and empty labels; first_word and last_word are null where no
phrase stands. Repeated rows each give their row. Only the key and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import PUNCT, slices, spans, table, utf8

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Family: keywords, one of them in each alternative of its name (words of a keyword may stand apart, but for `cc by`), regex of its name, versions.
FAMILIES = {
    "gpl": (("gnu",), r"gnu\s+general\s+public\s+licen[sc]e|gnu\s+gpl", ("1.0", "2.0", "3.0", "2", "3")),
    "lgpl": (("lesser", "library", "lgpl"), r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e|gnu\s+lgpl", ("2.0", "2.1", "3.0", "3")),
    "agpl": (("affero", "agpl"), r"gnu\s+affero\s+general\s+public\s+licen[sc]e|gnu\s+agpl", ("1.0", "3.0", "3")),
    "apache": (("apache",), r"apache\s+(?:software\s+)?licen[sc]e", ("1.0", "1.1", "2.0", "2")),
    "mit": (("mit",), r"mit\s+licen[sc]e|mit\s*/\s*x11\s+licen[sc]e", ()),
    "bsd-2-clause": (("bsd",), r"(?:simplified|2-clause)\s+bsd\s+licen[sc]e|bsd\s+2-clause", ()),
    "bsd-3-clause": (("bsd",), r"(?:new|revised|modified|3-clause)\s+bsd\s+licen[sc]e|bsd\s+3-clause", ()),
    "mpl": (("mozilla",), r"mozilla\s+public\s+licen[sc]e", ("1.0", "1.1", "2.0")),
    "epl": (("eclipse",), r"eclipse\s+public\s+licen[sc]e", ("1.0", "2.0")),
    "eupl": (("european",), r"european\s+union\s+public\s+licen[sc]e", ("1.0", "1.1", "1.2")),
    "cddl": (("common development",), r"common\s+development\s+and\s+distribution\s+licen[sc]e", ("1.0", "1.1")),
    "cc-by-nc-nd": (("cc by", "cc-by"), r"cc[ -]by[ -]nc[ -]nd", ("2.0", "2.5", "3.0", "4.0")),
    "cc-by-nc-sa": (("cc by", "cc-by"), r"cc[ -]by[ -]nc[ -]sa", ("2.0", "2.5", "3.0", "4.0")),
    "cc-by-nc": (("cc by", "cc-by"), r"cc[ -]by[ -]nc", ("2.0", "2.5", "3.0", "4.0")),
    "cc-by-nd": (("cc by", "cc-by"), r"cc[ -]by[ -]nd", ("2.0", "2.5", "3.0", "4.0")),
    "cc-by-sa": (("cc by", "cc-by"), r"cc[ -]by[ -]sa", ("2.0", "2.5", "3.0", "4.0")),
    "cc-by": (("cc by", "cc-by"), r"cc[ -]by", ("2.0", "2.5", "3.0", "4.0")),
    "cc0": (("cc0",), r"cc0", ("1.0",)),
    "isc": (("isc",), r"isc\s+licen[sc]e", ()),
    "zlib": (("zlib",), r"zlib\s+licen[sc]e", ()),
    "boost": (("boost",), r"boost\s+software\s+licen[sc]e", ("1.0",)),
    "artistic": (("artistic",), r"artistic\s+licen[sc]e", ("1.0", "2.0")),
    "unlicense": (("unlicense",), r"the\s+unlicense", ()),
    "wtfpl": (("wtfpl",), r"wtfpl", ("2",)),
    "odbl": (("open database",), r"open\s+database\s+licen[sc]e", ("1.0",)),
    "ofl": (("open font",), r"(?:sil\s+)?open\s+font\s+licen[sc]e", ("1.0", "1.1")),
    "psf": (("python software",), r"python\s+software\s+foundation\s+licen[sc]e", ("2",)),
}
#: Bare abbreviations, and those that count with a version only.
ABBREVIATIONS, WITH_VERSION = ("gpl", "lgpl", "agpl", "eupl", "cddl", "odbl"), ("mpl", "epl", "ofl")
_BEFORE = r"(?:this\s+\w+\s+is\s+)?(?:dual[- ])?(?:licen[sc]ed|released|distributed|available|published|covered)\s+(?:under|by)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"
_VERSION = r"[,;]?\s*\(?(?:version|ver\.?|v\.?)?\s*"
#: Single rules beside those of the families: label, keywords, regex, priority, confidence.
EXTRA = (
    ("mit", ("permission is hereby granted",), r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge", 4, 1.0),
    ("apache-2.0", ("apache.org/licenses",), r"https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?", 4, 1.0),
    ("gpl", ("gnu.org/licenses",), r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl[\w.-]*", 4, 1.0),
    ("lgpl", ("gnu.org/licenses",), r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl[\w.-]*", 4, 1.0),
    ("mpl-2.0", ("mozilla.org/mpl",), r"https?://(?:www\.)?mozilla\.org/mpl/2\.0/?", 4, 1.0),
    ("cc", ("creativecommons.org",), r"https?://(?:www\.)?creativecommons\.org/licenses/[a-z-]+/\d\.\d/?", 4, 1.0),
    ("cc0", ("creativecommons.org",), r"https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?", 4, 1.0),
    ("cc", ("creative commons",), r"creative\s+commons\s+(?:attribution|licen[sc]e|zero)[\w\s.-]{0,60}", 2, 0.8),
    ("public-domain", ("public domain",), r"(?:in|to|into)\s+the\s+public\s+domain", 2, 0.8),
    ("copyright", ("copyright",), r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d", 1, 0.5),
    ("copyright", ("rights reserved",), r"all\s+rights\s+reserved", 1, 0.5),
    ("proprietary", ("confidential",), r"confidential\s+and\s+proprietary|proprietary\s+and\s+confidential", 3, 0.8),
    ("proprietary", ("unauthorized",), r"unauthori[sz]ed\s+(?:copying|use|reproduction)[^.]{0,80}\s+(?:is\s+)?(?:strictly\s+)?prohibited", 3, 0.8),
)
#: Signatures of license texts and notices: label, keywords, wording. A space matches what separates words there (comment signs, line ends), `...` up to
#: 1,500 characters of the text between.
SIGNATURES = (
    ("bsd-3-clause", ("redistribution and use",), "redistribution and use in source and binary forms, with or without modification, are permitted ... neither the name of ... may be used to endorse or promote products"),
    ("bsd-3-clause", ("redistribution and use",), "redistribution and use in source and binary forms, with or without modification, are permitted ... the name of ... may not be used to endorse or promote products"),
    ("bsd-4-clause", ("redistribution and use",), "redistribution and use in source and binary forms, with or without modification, are permitted ... all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", ("redistribution and use",), "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("isc", ("permission to use",), "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", ("permission to use",), "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", ("permission to use",), "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("hpnd", ("permission to use",), "permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("zlib", ("as-is",), "this software is provided ['\"`‘“]as-is['\"`’”], without any express or implied warranty ... altered source versions must be plainly marked as such"),
    ("libpng", ("png reference library",), "the png reference library is supplied ['\"]?as is"),
    ("mit", ("hereby granted",), "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-0", ("hereby granted",), "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files ... to permit persons to whom the software is furnished to do so\\. the software is provided"),
    ("json", ("not evil",), "the software shall be used for good, not evil"),
    ("boost-1.0", ("accompanying documentation",), "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("x11", ("x consortium",), "except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("ncsa", ("ncsa",), "university of illinois/ncsa open source license"),
    ("gpl-1.0", ("general public license",), "gnu general public license[,;]? as published by the free software foundation[,;] either version 1,?(?: of the license)?,? or"),
    ("gpl-2.0", ("general public license",), "gnu general public license[,;]? as published by the free software foundation[,;] either version 2,?(?: of the license)?,? or"),
    ("gpl-3.0", ("general public license",), "gnu general public license[,;]? as published by the free software foundation[,;] either version 3,?(?: of the license)?,? or"),
    ("gpl-2.0", ("general public license",), "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", ("general public license",), "gnu general public license version 3 as published by the free software foundation"),
    ("lgpl-2.0", ("general public license",), "gnu (?:lesser|library) general public license[,;]? as published by the free software foundation[,;] either version 2,?(?: of the license)?,? or"),
    ("lgpl-2.1", ("general public license",), "gnu lesser general public license[,;]? as published by the free software foundation[,;] either version 2\\.1,?(?: of the license)?,? or"),
    ("lgpl-3.0", ("general public license",), "gnu lesser general public license[,;]? as published by the free software foundation[,;] either version 3,?(?: of the license)?,? or"),
    ("agpl-3.0", ("general public license",), "gnu affero general public license[,;]? as published by the free software foundation[,;] either version 3,?(?: of the license)?,? or"),
    ("gpl", ("any later version",), "at your option\\)? any later version"),
    ("apache-2.0", ("apache license",), "licensed under the apache license, version 2\\.0 \\(the [\"“]license[\"”]\\)"),
    ("apache-2.0", ("asf licenses this file",), "the asf licenses this file to you under the apache license, version 2\\.0"),
    ("apache-1.1", ("apache software foundation",), "this product includes software developed by the apache software foundation"),
    ("mpl-2.0", ("source code form",), "this source code form is subject to the terms of the mozilla public license, v\\. 2\\.0"),
    ("mpl-1.1", ("mozilla public license",), "the contents of this file are subject to the mozilla public license version 1\\.1"),
    ("epl-1.0", ("accompanying materials",), "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)?(?: )?1\\.0"),
    ("epl-2.0", ("accompanying materials",), "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)?(?: )?2\\.0"),
    ("cddl", ("common development",), "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", ("european union public licence",), "licensed under the eupl, version|licensed under the european union public licence"),
    ("artistic-2.0", ("artistic license",), "you may distribute under the terms of either the gnu general public license or the artistic license|this is free software\\. you may distribute it under the terms of the artistic license"),
    ("unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain"),
    ("wtfpl", ("what the fuck you want",), "do what the fuck you want to(?: public license)?"),
    ("cc0-1.0", ("possible under law",), "to the extent possible under law,? ... waived all copyright and related or neighbou?ring rights"),
    ("cc-by", ("creative commons",), "licensed under (?:a|the) creative commons attribution(?!(?: )?(?:non|no|share))"),
    ("cc-by-sa", ("creative commons",), "licensed under (?:a|the) creative commons attribution share(?: )?alike"),
    ("cc-by-nc", ("creative commons",), "licensed under (?:a|the) creative commons attribution non(?: )?commercial(?!(?: )?(?:no|share))"),
    ("cc-by-nc-sa", ("creative commons",), "licensed under (?:a|the) creative commons attribution non(?: )?commercial share(?: )?alike"),
    ("cc-by-nc-nd", ("creative commons",), "licensed under (?:a|the) creative commons attribution non(?: )?commercial no(?: )?deriv"),
    ("cc-by-nd", ("creative commons",), "licensed under (?:a|the) creative commons attribution no(?: )?deriv"),
    ("odbl-1.0", ("open database license",), "made available under the open database license"),
    ("ofl-1.1", ("open font license",), "this font software is licensed under the sil open font license, version 1\\.1"),
    ("psf-2.0", ("python software foundation",), "this license agreement is between the python software foundation"),
    ("php-3.01", ("php license",), "this source file is subject to version 3\\.01 of the php license"),
    ("ruby", ("ruby's license",), "(?:same terms as ruby|distributed under the terms of ruby's license|under ruby's license)"),
    ("openssl", ("openssl",), "this product includes software developed by the openssl project"),
    ("freetype", ("freetype",), "(?:distributed|used) under the (?:terms of the )?freetype (?:project )?license"),
    ("ms-pl", ("microsoft public license",), "microsoft public license(?: \\(ms-pl\\))?"),
    ("ms-rl", ("microsoft reciprocal license",), "microsoft reciprocal license(?: \\(ms-rl\\))?"),
    ("afl-3.0", ("academic free license",), "licensed under the academic free license version 3\\.0"),
    ("beerware", ("buy me a beer",), "you can buy me a beer in return"),
    ("vim", ("vim license",), "(?:distributed )?under the (?:terms of the )?vim license"),
    ("sleepycat", ("complete source code",), "redistributions in any form must be accompanied by information on how to obtain complete source code"),
)

#: SPDX identifiers that aren't a family with its version.
TAGS = {"0bsd": "0bsd", "bsl-1.0": "boost-1.0", "python-2.0": "psf-2.0", "sspl-1.0": "sspl-1.0", "busl-1.1": "busl-1.1"}

#: Label, keywords and name of licenses without families.
NAMES = (
    ("bsd", ("bsd",), r"bsd\s+licen[sc]e"),
    ("sspl-1.0", ("server side",), r"server\s+side\s+public\s+licen[sc]e"),
    ("busl-1.1", ("business source",), r"business\s+source\s+licen[sc]e"),
)


def _wording(wording: str) -> str:
    return r"[\s\S]{0,1500}?".join(part.replace(" ", _GAP) for part in wording.split(" ... "))


_GAP = r"[\s*#/;%>|-]+"


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, tuple[str, ...], re.Pattern, int, float]]:
    """(label, keywords, regex over lower-cased text, priority, confidence), highest priority first."""
    out = []
    for label, (keywords, name, versions) in FAMILIES.items():
        name = rf"(?<!\w)(?:{name})(?!\w)"
        forms = [("", 4, "")] if not versions else [("", 2, "")]
        for version in versions:
            number = re.escape(version) + (r"(?:\.0)?" if "." not in version else "")
            forms.append((f"-{version if '.' in version else version + '.0'}", 4, rf"{_VERSION}{number}\)?(?![\w]|\.\d)"))
        for suffix, priority, tail in forms:
            out.append((label + suffix, keywords, re.compile(_BEFORE + name + tail), priority + 2, 1.0))
            out.append((label + suffix, keywords, re.compile(name + tail), priority, 0.8))
            out.append((label + suffix, ("spdx-license-identifier",), re.compile(rf"spdx-license-identifier:\s*{re.escape(label + suffix)}(?:-only|-or-later)?(?![\w.-])"), priority + 3, 1.0))
            if label in ABBREVIATIONS or suffix and label in WITH_VERSION:
                out.append((label + suffix, (label,), re.compile(rf"(?<!\w){label}-?{tail}" if suffix else rf"(?<!\w){label}(?!\w)"), 1 if suffix else 0, 0.5))
    out += [(label, keywords, re.compile(regex), priority, confidence) for label, keywords, regex, priority, confidence in EXTRA]
    out += [(label, ("spdx-license-identifier",), re.compile(rf"spdx-license-identifier:\s*{re.escape(tag)}(?![\w.-])"), 7, 1.0) for tag, label in TAGS.items()]
    out += [(label, keywords, re.compile(rf"(?<!\w)(?:{name})(?!\w)"), 4, 0.8) for label, keywords, name in NAMES]
    out += [(label, keywords, re.compile(_wording(wording)), 6, 1.0) for label, keywords, wording in SIGNATURES]
    return sorted(out, key=lambda r: -r[3])


def detect(low: str, known: list | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) of what the rules find in a lower-cased text, contained detections suppressed."""
    present: dict[tuple[str, ...], bool] = {}
    kept: list[tuple[int, int, str, float]] = []
    for _, level in groupby(known or rules(), key=lambda r: r[3]):
        found = []
        for label, keywords, regex, _, confidence in level:
            if keywords not in present:
                present[keywords] = any(k in low if k == "cc by" else all(part in low for part in k.split()) for k in keywords)
            if present[keywords]:
                found += [(*m.span(), label, confidence) for m in regex.finditer(low)]
        if found:  # from left to right, longest first: a span lies within another just where one before it ends no earlier
            both = sorted([(x[0], -x[1], 0, x) for x in kept] + [(x[0], -x[1], 1 + i, x) for i, x in enumerate(found)])
            reach = -1
            for _, end, new, x in both:
                if new and reach < -end:
                    kept.append(x)
                reach = max(reach, -end)
    return sorted(kept)


_WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
_BETWEEN = "[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BASE = [(re.compile(f"(?<!{_WORD}){_BETWEEN.join(p.split())}(?!{_WORD})"), p.split()[-1], p.split()[0], label) for p, label in PHRASES.items()]
_LOWER = {i: i + 32 for i in range(65, 91)}


def license_labels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: key, n_words, the base phrases' places (`base`: array of label and word), the
    detections that are left (`found`: array of label, start, end in code points of the lower-cased text, confidence)."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, base array<struct<label:string,word:long>>, found array<struct<label:string,start:long,end:long,confidence:double>>"
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(f"{_WORD}+")
        known = rules()
        for b in slices(batches, "t"):
            raw, off = utf8(b.column("t"))
            n_words = np.diff(spans(raw, off, PUNCT)[2])
            base, found = [], []
            for t in b.column("t").to_pylist():
                low = (t or "").translate(_LOWER) if t and not t.isascii() else (t or "").lower()
                places = []
                for regex, last, head, label in _BASE:
                    if head in low and last in low:
                        places += [(label, m.start()) for m in regex.finditer(low)]
                if places:
                    starts = [m.start() for m in words.finditer(low)]
                    places = [(label, int(np.searchsorted(starts, s))) for label, s in places]
                base.append([{"label": label, "word": w} for label, w in places])
                found.append([{"label": label, "start": s, "end": e, "confidence": c} for s, e, label, c in detect(low, known)])
            yield pa.RecordBatch.from_pydict({key: b.column("k"), "n_words": pa.array(n_words, pa.int64()), "base": pa.array(base, base_type), "found": pa.array(found, found_type)})

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) as long) as n_base",
        "array_min(base.word) as first_word",
        "array_max(base.word) as last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, found.label))), ',') as labels",
        "greatest(if(size(base) > 0, 0.8D, 0D), coalesce(array_max(found.confidence), 0D)) as score",
    )


