"""License scans: ordered signature rules behind a keyword gate; in DataFrame operations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stage, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels; their labels are always kept.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Signature rules in order: priority, label, keyword that must occur, pattern over words parted by one space.
#: Priority 1 names a license and a version or quotes its text, 2 names a license, 3 is a general mention.
RULES = r"""
1 apache-2.0 | apache | (?:the )?apache license (?:version |v)?2 0
1 apache-2.0 | apache | apache (?:software )?license v ?2(?: 0)?
1 apache-2.0 | apache | licensed under the apache license (?:version )?2 0(?: the license)?
1 apache-2.0 | apache | (?:spdx license identifier )?apache 2 0
1 apache-2.0 | apache | apache org licenses license 2 0
1 apache-1.1 | apache | apache (?:software )?license (?:version )?1 1
1 apache-1.0 | apache | apache (?:software )?license (?:version )?1 0
2 apache | apache | apache (?:public |software )?licen[sc]ed?
2 apache | apache | licensed to the apache software foundation
1 mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
1 mit | mit | (?:released|licensed|available|distributed|published) under (?:the )?(?:terms of the )?mit licen[sc]e
1 mit | mit | spdx license identifier mit
1 mit | mit | opensource org licenses mit(?: license)?(?: php)?
2 mit | mit | (?:the )?mit licen[sc]e
2 mit | mit | mit licensed
2 mit | mit | mit x11(?: licen[sc]e)?
2 x11 | x11 | x11 licen[sc]e
1 mit-0 | mit | mit no attribution
1 mit-0 | mit | mit 0 licen[sc]e
1 bsd-2-clause | bsd | (?:simplified|freebsd) bsd(?: licen[sc]e)?
1 bsd-2-clause | bsd | bsd 2 clause(?: licen[sc]e)?
1 bsd-2-clause | bsd | (?:two|2) clause bsd(?: licen[sc]e)?
1 bsd-3-clause | bsd | (?:new|modified|revised) bsd(?: licen[sc]e)?
1 bsd-3-clause | bsd | bsd 3 clause(?: licen[sc]e)?
1 bsd-3-clause | bsd | (?:three|3) clause bsd(?: licen[sc]e)?
1 bsd-4-clause | bsd | bsd 4 clause(?: licen[sc]e)?
1 bsd-4-clause | bsd | (?:original|old|four clause|4 clause) bsd(?: licen[sc]e)?
1 0bsd | bsd | (?:zero clause bsd|0bsd|bsd zero clause)(?: licen[sc]e)?
1 bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
1 bsd-3-clause | neither | neither the name of .{1,80}? nor the names of its contributors may be used to endorse
1 bsd | redistributions | redistributions of source code must retain the above copyright notice
1 bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
2 bsd | bsd | bsd (?:style )?licen[sc]ed?
2 bsd | bsd | berkeley software distribution
1 gpl-3.0 | general | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v)?3(?: 0)?
1 gpl-2.0 | general | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v)?2(?: 0)?
1 gpl-1.0 | general | gnu general public licen[sc]e (?:version |v)?1(?: 0)?
1 gpl-3.0 | gpl | (?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)?
1 gpl-2.0 | gpl | (?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?(?: only| or later)?
1 gpl-3.0 | gplv3 | (?:gnu )?gplv3
1 gpl-2.0 | gplv2 | (?:gnu )?gplv2
1 gpl-3.0 | general | general public licen[sc]e (?:version |v)3(?: 0)?
1 gpl-2.0 | general | general public licen[sc]e (?:version |v)2(?: 0)?
1 gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
2 gpl | general | (?:the )?gnu general public licen[sc]e
2 gpl | gpl | (?:gnu )?gpl(?: licen[sc]ed?)?
1 lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[sc]e (?:version |v)?3(?: 0)?
1 lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[sc]e (?:version |v)?2 1
1 lgpl-2.0 | library | (?:gnu )?library general public licen[sc]e (?:version |v)?2(?: 0)?
1 lgpl-3.0 | lgpl | lgpl ?v?(?:ersion )?3(?: 0)?
1 lgpl-2.1 | lgpl | lgpl ?v?(?:ersion )?2 1
1 lgpl-2.0 | lgpl | lgpl ?v?(?:ersion )?2 0
1 lgpl-3.0 | lgplv3 | lgplv3
1 lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
1 lgpl | lesser | (?:gnu )?lesser general public licen[sc]e
1 lgpl | library | (?:gnu )?library general public licen[sc]e
2 lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]ed?)?
1 agpl-3.0 | affero | (?:gnu )?affero general public licen[sc]e (?:version |v)?3(?: 0)?
1 agpl-1.0 | affero | affero general public licen[sc]e (?:version |v)?1(?: 0)?
1 agpl-3.0 | agpl | agpl ?v?(?:ersion )?3(?: 0)?
1 agpl-3.0 | agplv3 | agplv3
1 agpl | affero | (?:gnu )?affero general public licen[sc]e
2 agpl | agpl | (?:gnu )?agpl(?: licen[sc]ed?)?
1 gfdl-1.3 | documentation | (?:gnu )?free documentation licen[sc]e (?:version |v)?1 3
1 gfdl-1.2 | documentation | (?:gnu )?free documentation licen[sc]e (?:version |v)?1 2
1 gfdl-1.1 | documentation | (?:gnu )?free documentation licen[sc]e (?:version |v)?1 1
2 gfdl | documentation | (?:gnu )?free documentation licen[sc]e
2 gfdl | gfdl | gfdl
1 mpl-2.0 | mozilla | mozilla public licen[sc]e (?:version |v)?2(?: 0)?
1 mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v)?1 1
1 mpl-1.0 | mozilla | mozilla public licen[sc]e (?:version |v)?1 0
1 mpl-2.0 | mpl | mpl ?v?2(?: 0)?
1 mpl-2.0 | mozilla | subject to the terms of the mozilla public licen[sc]e v 2 0
2 mpl | mozilla | mozilla public licen[sc]e
1 epl-2.0 | eclipse | eclipse public licen[sc]e (?:version |v)?2(?: 0)?
1 epl-1.0 | eclipse | eclipse public licen[sc]e (?:version |v)?1(?: 0)?
2 epl | eclipse | eclipse public licen[sc]e
1 edl-1.0 | eclipse | eclipse distribution licen[sc]e(?: v?1 0)?
1 cddl-1.1 | cddl | cddl ?(?:version |v)?1 1
1 cddl-1.0 | cddl | cddl ?(?:version |v)?1 0
1 cddl | common | common development and distribution licen[sc]e
2 cddl | cddl | cddl
1 cpl-1.0 | common | common public licen[sc]e (?:version |v)?1 0
2 cpl | common | common public licen[sc]e
1 cpal-1.0 | common | common public attribution licen[sc]e(?: (?:version |v)?1 0)?
1 ms-pl | microsoft | microsoft public licen[sc]e
1 ms-rl | microsoft | microsoft reciprocal licen[sc]e
1 ms-pl | ms | ms pl
1 ms-rl | ms | ms rl
1 artistic-2.0 | artistic | artistic licen[sc]e (?:version |v)?2(?: 0)?
1 artistic-1.0 | artistic | artistic licen[sc]e (?:version |v)?1(?: 0)?
2 artistic | artistic | (?:perl )?artistic licen[sc]e
1 zlib | zlib | zlib libpng licen[sc]e
1 zlib | zlib | zlib licen[sc]e
1 zlib | altered | altered source versions must be plainly marked as such
1 libpng | libpng | libpng licen[sc]e
1 bsl-1.0 | boost | boost software licen[sc]e (?:version |v)?1 0
2 bsl-1.0 | boost | boost (?:software )?licen[sc]e
1 busl-1.1 | business | business source licen[sc]e (?:version |v)?1 1
2 busl | business | business source licen[sc]e
1 isc | isc | isc licen[sc]ed?
1 isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 unlicense | unlicense | (?:the )?unlicense
1 wtfpl | wtfpl | wtfpl
1 wtfpl | public | do what the fuck you want to public licen[sc]e
1 cc0-1.0 | cc0 | cc0 1 0(?: universal)?
1 cc0-1.0 | creative | creative commons zero(?: v?1 0)?
2 cc0 | cc0 | cc0
1 cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
1 cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
1 cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
1 cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
1 cc-by-nc-sa-2.5 | cc | cc by nc sa 2 5
1 cc-by-nc-4.0 | cc | cc by nc 4 0
1 cc-by-nc-3.0 | cc | cc by nc 3 0
1 cc-by-nc-2.5 | cc | cc by nc 2 5
1 cc-by-nd-4.0 | cc | cc by nd 4 0
1 cc-by-nd-3.0 | cc | cc by nd 3 0
1 cc-by-sa-4.0 | cc | cc by sa 4 0
1 cc-by-sa-3.0 | cc | cc by sa 3 0
1 cc-by-sa-2.5 | cc | cc by sa 2 5
1 cc-by-sa-2.0 | cc | cc by sa 2 0
1 cc-by-4.0 | cc | cc by 4 0
1 cc-by-3.0 | cc | cc by 3 0
1 cc-by-2.5 | cc | cc by 2 5
1 cc-by-2.0 | cc | cc by 2 0
2 cc-by-nc-nd | cc | cc by nc nd
2 cc-by-nc-sa | cc | cc by nc sa
2 cc-by-nc | cc | cc by nc
2 cc-by-nd | cc | cc by nd
2 cc-by-sa | cc | cc by sa
2 cc-by | cc | cc by
1 cc-by-nc-nd-4.0 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?
1 cc-by-nc-sa-4.0 | creative | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
1 cc-by-nc-4.0 | creative | creative commons attribution non ?commercial 4 0(?: international)?
1 cc-by-nd-4.0 | creative | creative commons attribution no ?deriv(?:ative)?s? 4 0(?: international)?
1 cc-by-sa-4.0 | creative | creative commons attribution share ?alike 4 0(?: international)?
1 cc-by-sa-3.0 | creative | creative commons attribution share ?alike 3 0(?: unported)?
1 cc-by-4.0 | creative | creative commons attribution 4 0(?: international)?
1 cc-by-3.0 | creative | creative commons attribution 3 0(?: unported)?
2 cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
2 cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike
2 cc-by-nc | creative | creative commons attribution non ?commercial
2 cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s?
2 cc-by-sa | creative | creative commons attribution share ?alike
2 cc-by | creative | creative commons attribution
3 creative-commons | creative | creative commons(?: licen[sc]ed?)?
1 cc-by | creativecommons | creativecommons org licenses by [1-4] [0-9]
1 cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [0-9]
1 cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [0-9]
1 cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [0-9]
1 cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [0-9]
1 cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [0-9]
1 cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
1 cc-pdm-1.0 | creativecommons | creativecommons org publicdomain mark 1 0
1 odbl-1.0 | open | open data(?:base)? (?:commons )?(?:open database )?licen[sc]e (?:version |v)?1 0
2 odbl | odbl | odbl
2 odbl | open | open database licen[sc]e
1 odc-by-1.0 | open | open data commons attribution licen[sc]e(?: v?1 0)?
1 pddl-1.0 | public | (?:open data commons )?public domain dedication and licen[sc]e(?: v?1 0)?
1 ogl-3.0 | open | open government licen[sc]e (?:version |v)?3 0
1 ogl-2.0 | open | open government licen[sc]e (?:version |v)?2 0
2 ogl | open | open government licen[sc]e
1 etalab-2.0 | ouverte | licence ouverte(?: open licence)?(?: version)? 2 0
2 etalab | ouverte | licence ouverte
1 ofl-1.1 | sil | sil open font licen[sc]e (?:version |v)?1 1
2 ofl | open | (?:sil )?open font licen[sc]e
1 eupl-1.2 | european | european union public licen[sc]e (?:version |v)?1 2
1 eupl-1.1 | european | european union public licen[sc]e (?:version |v)?1 1
2 eupl | european | european union public licen[sc]e
2 eupl | eupl | eupl(?: v?1 [12])?
1 osl-3.0 | open | open software licen[sc]e (?:version |v)?3 0
2 osl | open | open software licen[sc]e
1 afl-3.0 | academic | academic free licen[sc]e (?:version |v)?3 0
1 afl-2.1 | academic | academic free licen[sc]e (?:version |v)?2 1
2 afl | academic | academic free licen[sc]e
1 ecl-2.0 | educational | educational community licen[sc]e (?:version |v)?2 0
2 ecl | educational | educational community licen[sc]e
1 psf-2.0 | python | python software foundation licen[sc]e (?:version |v)?2
2 psf | python | (?:python software foundation|psf|python) licen[sc]e
1 php-3.01 | php | php licen[sc]e (?:version |v)?3 01
2 php | php | php licen[sc]e
1 ruby | ruby | ruby(?: s)? licen[sc]e
1 zpl-2.1 | zope | zope public licen[sc]e (?:version |v)?2 1
2 zpl | zope | zope public licen[sc]e
1 w3c | w3c | w3c software (?:notice and )?(?:document )?licen[sc]e
1 openssl | openssl | openssl licen[sc]e
1 ssleay | ssleay | (?:original )?ssleay licen[sc]e
1 curl | curl | curl licen[sc]e
1 icu | icu | icu licen[sc]e
1 unicode | unicode | unicode (?:inc )?licen[sc]e agreement
1 ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
1 postgresql | postgresql | postgresql licen[sc]e
1 sleepycat | sleepycat | sleepycat licen[sc]e
1 vim | vim | vim licen[sc]e
1 jsonlicense | evil | the software shall be used for good not evil
1 beerware | beer | beer ?ware licen[sc]e
1 sspl-1.0 | server | server side public licen[sc]e(?: (?:version |v)?1)?
1 elastic-2.0 | elastic | elastic licen[sc]e (?:version |v)?2 0
2 elastic | elastic | elastic licen[sc]e
1 commons-clause | commons | commons clause(?: licen[sc]e condition)?
1 polyform-nc | polyform | polyform noncommercial licen[sc]e
1 upl-1.0 | universal | universal permissive licen[sc]e(?: (?:version |v)?1 0)?
1 blueoak-1.0.0 | blue | blue oak model licen[sc]e(?: 1 0 0)?
1 mulan-2.0 | mulan | mulan permissive software licen[sc]e(?: (?:version |v)?2)?
1 openrail | openrail | (?:creativeml )?openrail(?: m| \+\+)?(?: licen[sc]e)?
1 llama | llama | llama (?:[23] )?community licen[sc]e(?: agreement)?
1 ipl-1.0 | ibm | ibm public licen[sc]e(?: (?:version |v)?1 0)?
1 apsl-2.0 | apple | apple public source licen[sc]e(?: (?:version |v)?2 0)?
1 nasa-1.3 | nasa | nasa open source agreement(?: (?:version |v)?1 3)?
1 qpl-1.0 | public | q public licen[sc]e(?: (?:version |v)?1 0)?
1 lppl-1.3c | latex | latex project public licen[sc]e(?: (?:version |v)?1 3c?)?
1 cecill-2.1 | cecill | cecill(?: free software licen[sc]e(?: agreement)?)?(?: (?:version |v)?2 1)?
2 cecill | cecill | cecill(?: [bc])?
1 public-domain | public | (?:released|placed|dedicated|is) (?:in ?to|in|to) the public domain
2 public-domain | public | public domain
2 reserved | rights | all rights (?:are )?reserved
2 reserved | rights | some rights reserved
2 no-rights-reserved | rights | no rights reserved
3 copyright | copyright | copyright (?:c )?(?:[12][0-9]{3} )?(?:by )?
3 copyrighted | copyrighted | (?:is )?copyrighted (?:material|work)
2 proprietary | proprietary | proprietary and confidential
2 proprietary | permission | (?:may not|not be) (?:be )?(?:reproduced|copied|distributed) without (?:prior )?(?:written )?permission
2 proprietary | commercial | (?:for )?non ?commercial use only
2 eula | user | end user licen[sc]e agreement
3 spdx | spdx | spdx license identifier
3 licensed | licen | (?:this work is |is )?licen[sc]ed under
3 license-text | licen | (?:see|refer to) the (?:file )?licen[sc]e(?: file)?(?: for details)?
"""
#: Confidence of a detection by the priority of its rule.
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.4}


def rules() -> list[dict]:
    """RULES as records: rule (its place), priority, label, keyword, pattern."""
    out = []
    for line in RULES.strip().splitlines():
        head, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
        priority, label = head.split()
        out.append({"rule": len(out), "priority": int(priority), "label": label, "keyword": keyword, "pattern": f"(?<= )(?:{pattern.strip()})(?= )"})
    return out


def normalised(text: Column) -> Column:
    """The words of a text in lower case (A to Z only) with one blank around each; no words: one blank."""
    inner = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


_HITS = "array<struct<start:bigint,stop:bigint>>"


def places(words: Column, pattern: Column) -> Column:
    """(start, stop) in words of each match of a pattern in normalised words; stop is exclusive.

    The text between matches and the matches alternate, so a running count of blanks gives the places.
    """
    between, found = F.split(words, pattern), F.regexp_extract_all(words, pattern, F.lit(0))
    zero = F.struct(F.lit(-1).cast("bigint").alias("at"), F.array().cast(_HITS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + _blanks(pair["gap"])
        stop = start + _blanks(pair["hit"])
        return F.struct(stop.cast("bigint").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("bigint").alias("start"), (stop + 1).cast("bigint").alias("stop")))).alias("out"))

    pairs = F.zip_with(between, found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), zero, step, lambda acc: acc["out"])


def _literal(rows: list[dict], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)


def detections(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, base, hits) of each row of docs, as a written table.

    base lists the places of the base phrases with their labels, hits those of the rules whose keyword
    occurs, with the rule's place and priority.
    """
    table_of_rules = rules()
    keywords = sorted({r["keyword"] for r in table_of_rules} | set(BASE))
    kind = "array<struct<rule:int,priority:int,label:string,keyword:string,pattern:string>>"
    base = _literal([{"label": label, "pattern": f"(?<= ){phrase}(?= )"} for phrase, label in BASE.items()], "array<struct<label:string,pattern:string>>")
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", normalised(F.col("text")).alias("words"))
    gated = words.select("*", F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains("words", k)).alias("keys"))
    any_key = F.size("keys") > 0

    def base_hits(b: Column) -> Column:
        return F.transform(places(F.col("words"), b["pattern"]), lambda p: F.struct(p["start"].alias("start"), b["label"].alias("label")))

    def rule_hits(r: Column) -> Column:
        return F.transform(places(F.col("words"), r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), r["rule"].alias("rule"), r["priority"].alias("priority"), r["label"].alias("label")))

    mine = F.filter(_literal(table_of_rules, kind), lambda r: F.array_contains("keys", r["keyword"]))
    out = gated.select(
        "row",
        "doc_id",
        F.greatest(_blanks(F.col("words")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(any_key, F.flatten(F.transform(base, base_hits))).alias("base"),
        F.when(any_key, F.flatten(F.transform(mine, rule_hits))).alias("hits"),
    )
    return stage(out, "licenses")


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of docs.

    Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased. A detection
    inside another one whose priority is as good is suppressed; of equal ones the first rule's stays. labels are
    those of the detections left and of the base phrases; spans lists the detections left as (start,
    stop, label) in words; score is the best confidence among them, 0 without any. Null, empty and blank
    texts have no words and no labels. Rows repeated come back repeated; other columns are ignored.
    """
    found = detections(docs)
    hit = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    earlier = Window.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(earlier)) for p in (1, 2, 3)])
    left = hit.withColumn("reach", reach).where("reach IS NULL OR reach < stop")
    confidence = F.coalesce(*[F.when(F.col("priority") == p, F.lit(c)) for p, c in CONFIDENCE.items()])
    kept = left.groupBy("row").agg(F.collect_set("label").alias("rule_labels"), F.max(confidence).alias("score"), F.sort_array(F.collect_list(F.struct("start", "stop", "label"))).alias("spans"))
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    none = F.array().cast("array<string>")
    out = found.join(kept, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.when(F.col("base").isNotNull(), F.size("base")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.coalesce(base_labels, none).alias("b"),
        F.coalesce("rule_labels", none).alias("r"),
        F.coalesce(F.col("score"), F.when(F.size("base") > 0, F.lit(CONFIDENCE[2])), F.lit(0.0)).alias("score"),
        "spans",
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("b"), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union("b", "r")), ",").alias("labels"), "score", "spans")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_scan over documents, without the spans."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op4_license_scan": op4_license_scan}
SQL: dict[str, str] = {}
