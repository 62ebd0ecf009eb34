"""Tokens, chats, archives, licences, secrets, leaks and scores."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from perilscope.llm import (bpe, chat_format, decontam, license_scan, quality_cnn,
                            secret_scan, textkernel, warc)

from . import helpers as H

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    return H.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, H.DOCS).repartition(4)
    return df.select("*", F.lit(1).alias("ids"), F.lit("y").alias("part"),
                     F.lit(2).alias("base"), F.lit(0.5).alias("score"), F.lit(3).alias("w"))


# -- byte-level BPE -----------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


ODD = ["a", "re", "s", "'", "'s", "'ll", " ", "  ", "\n", "\t", " ", "1", "²", "é", "中",
       "😀", "!", "..", "\x1c", "\x85", "​", "े", " ", "don't", "\r\n", "\x00"]


def test_ids_equal_the_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(15))) for _ in range(20_000)]
    texts += ["ab" * 3000, "é" * 500 + "'re", " " * 300]
    vocab = bpe.Vocabulary(open(RANKS, "rb").read())
    got = []
    for s in textkernel.slices(pa.record_batch([pa.array(texts)], names=["t"]), "t"):
        got += bpe._encode_rows(s, vocab).to_pylist()
    assert got == [library.encode_ordinary(t) for t in texts]


def test_stitching_equals_one_cut():
    rng = random.Random(4)

    def cut(text):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.flatnonzero(bpe.boundaries(points, np.array([0, len(points)])))

    for _ in range(800):
        text = "".join(rng.choices(ODD, k=150)) + "a" * rng.choice([0, 0, 60])
        size, overlap = rng.choice([16, 23, 40]), rng.choice([4, 8, 15])
        chunks = []
        for k in range(-(-len(text) // size)):
            a = max(0, k * size - overlap)
            part = text[a:(k + 1) * size]
            chunks.append((a, part, cut(part)))
        whole, found = bpe.stitch(chunks)
        assert whole == text and found.tolist() == cut(text).tolist()


def test_round_trip_of_all_rows(docs, rows, library):
    got = bpe.decode(bpe.encode(docs, RANKS, chunk=300, overlap=40), RANKS).collect()
    want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    assert sorted([(r.doc_id, list(r.ids), bytes(r.decoded)) for r in got], key=H.order) \
        == sorted(want, key=H.order)


def test_tokens_of_nothing(spark):
    empty = bpe.encode(spark.createDataFrame([], H.DOCS), RANKS)
    assert bpe.decode(empty, RANKS).count() == 0


# -- chat formatting ----------------------------------------------------------

CHATS = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 0, "system", "\n\n"), (1, 1, "user", " "), (1, 2, "assistant", "\\.\\<s>\\\\<\\.s>"),
    (2, 0, "assistant", "first"), (2, 1, "we<s>ird", None), (2, 2, None, "x <</SYS>>\n"),
    (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, None, "user", ""),
    (None, 5, "user", "no id"), (4, 0, "user", "y" * 30_000),
]


def test_chats_read_back(spark):
    df = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("valid", F.lit("clash")).withColumn("turns", F.lit(1)).repartition(3)
    got = (chat_format.format_chats(df)
           .withColumn("t", chat_format.parse(F.col("formatted"))).collect())
    want = {}
    for c, n, role, text in CHATS:
        want.setdefault(c, []).append(((n is not None, n or 0), role or "", text or ""))
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        turns = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.t] == turns
        assert [t.loss for t in r.t] == [role == "assistant" for role, _ in turns]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert {r.conv_id: r.valid for r in got} == {
        -7: True, 1: True, 2: False, 3: False, None: True, 4: True}
    assert chat_format.format_chats(df.limit(0)).count() == 0


# -- WARC ---------------------------------------------------------------------

def test_archives_read_back(spark):
    big = "x" * 5000
    pages = [(1, "u", big), (2, "u\r\n2", big), (2, "u3", big), (None, None, big),
             (3, "e", None), (4, "e", "é" * 600), (5, "e", "é" * 600), (6, "e", "é" * 499),
             (7, "e", "é" * 499), (8, None, "a\r\n\r\nContent-Length: 3\r\n\r\nb"),
             (9, "long", "long " * 700_000)]
    df = (spark.createDataFrame(pages, "page_id bigint, url string, html string")
          .withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1)).repartition(3))
    index, folder = warc.archive(spark, df)
    got = warc.digests(warc.read_bundles(index, folder)).collect()
    top = {}
    for p, _, h in pages:
        if p is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, p), p)
    want = []
    for p, _, h in pages:
        body = (h or "").encode()
        again = h in top and (p is None or p < top[h])
        want.append((p, len(body), hashlib.sha1(body).hexdigest(),
                     "revisit" if again else "response", top[h] if again else None))
    assert sorted([tuple(r) for r in got], key=H.order) == sorted(want, key=H.order)
    one = spark.createDataFrame([("urn:page:9",), ("urn:page:4",)], "record_id string")
    found = {r.page_id: r for r in warc.fetch(index, folder, one).collect()}
    assert found[9].payload == bytearray(("long " * 700_000).encode())
    assert found[4].record_type == "revisit" and found[4].refers_to == 5
    empty, where = warc.archive(spark, df.limit(0))
    assert warc.read_bundles(empty, where).count() == 0


# -- licences -----------------------------------------------------------------

APACHE = """/* Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES. See the License for the specific language governing permissions and
 * limitations under the License. */"""


def test_licences(spark):
    rows = [
        (1, APACHE, "Apache-2.0", 0), (2, None, "", 0), (3, "", "", 0),
        (4, "Released under the MIT License.\nx y. Licensed under CC BY-NC 4.0.",
         "MIT,CC-BY-NC-4.0", 0),
        (5, "All rights reserved. licensed under the GNU General Public License, version 3.",
         "GPL-3.0", 1),
        (6, "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License, either version 3 of the License.",
         "GPL-3.0", 0),
        (7, "no licence here, nor permission", "", 0), (8, "plain " * 20_000, "", 0),
        (8, "MIT License. MIT License", "MIT,MIT", 0),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    df = df.withColumn("licenses", F.lit("clash"))
    got = license_scan.scan(df, ["doc_id"]).collect()
    assert sorted((r.doc_id, ",".join(r.licenses), r.n_unmatched) for r in got) == sorted(
        (r[0], *r[2:]) for r in rows)
    assert license_scan.scan(df.limit(0), ["doc_id"]).count() == 0


def notice(name, version, mark):
    """The standard notice of a GNU licence."""
    return f"""This program is free software; you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation{mark} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this program; if not, see <https://www.gnu.org/licenses/>."""


def test_gnu_notices_and_spdx_lines(spark):
    gnu = [("General Public License", 2, "GPL-2.0"), ("General Public License", 3, "GPL-3.0"),
           ("Lesser General Public License", 3, "LGPL-3.0"),
           ("Affero General Public License", 3, "AGPL-3.0")]
    rows = [(text, licence, 0) for name, version, licence in gnu for mark in ";,"
            for whole in [notice(name, version, mark)]
            for text in (whole, whole.split("\n\n")[0])]
    line = "SPDX-License-Identifier: "
    rows += [
        (line + "MIT", "MIT", 0), (f"// {line}MIT\n#include <x.h>\nint mit;", "MIT", 0),
        (f"/* {line}GPL-2.0-only */ int a;", "GPL-2.0", 0), (line + "GPL-3.0+.", "GPL-3.0", 0),
        (f"# {line}(Apache-2.0 OR MIT) AND BSD-3-Clause\nimport x",
         "Apache-2.0,MIT,BSD-3-Clause", 0),
        (f"# {line}LGPL-3.0-or-later\n# {line}CC-BY-NC-4.0\n", "LGPL-3.0,CC-BY-NC-4.0", 0),
        (line + "GPL-2.0 WITH Classpath-exception-2.0 OR ISC and more", "GPL-2.0,ISC", 0),
        (line + "BSD-3-Clause-Clear", "", 1), (line + "Other-1.0", "", 1),
        ("MIT is not named by spdx here", "", 0),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)],
                               "doc_id bigint, text string")
    got = {r.doc_id: (",".join(r.licenses), r.n_unmatched)
           for r in license_scan.scan(df, ["doc_id"]).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_every_known_sentence_has_a_cue():
    cue = re.compile(license_scan.CUE)
    assert all(cue.search(p) for p in license_scan.SENTENCES.values())
    assert all(i in license_scan.SENTENCES for _, ids in license_scan.RULES for i in ids)


NOTICES = {
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
               "v. 2.0. If a copy of the MPL was not distributed with this file, you can get one.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under "
                "the terms of the GNU Lesser General Public License as published by the Free "
                "Software Foundation; either version 2.1 of the License, or any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the "
               "terms of the GNU General Public License version 2 as published by the FSF.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See the file.)",
    "EPL-2.0": "This program is made available under the terms of the Eclipse Public License "
               "v. 2.0 which is available at the site.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no "
            "event will the authors be held liable for any damages. Permission is granted to "
            "anyone to use this software for any purpose, subject to these: 1. The origin of "
            "this software must not be misrepresented; you must not claim it. 2. Altered source "
            "versions must be plainly marked as such. 3. This notice may not be removed or "
            "altered from any source distribution.",
}


def test_common_notices_and_denials(spark):
    rows = [*NOTICES.values(), "Not licensed under Apache License, Version 2.0.",
            "Do not use the MIT License.", "Licensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: (list(r.licenses), r.n_unmatched)
           for r in license_scan.scan(df, ["doc_id"]).collect()}
    want = [([k], 0) for k in NOTICES] + [([], 0), ([], 0), (["Apache-2.0"], 0)]
    assert [got[i] for i in range(len(rows))] == want


# -- secrets ------------------------------------------------------------------

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)", re.A)


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_and_redaction(spark):
    rng = random.Random(8)
    parts = ["token", "Secret", "API_KEY", "apikey", "password", ":", "=", " ", "'", '"', "é",
             "abcdefgh", "x1", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "deadbeef",
             "\n", "/", "中"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400)]
    texts += [None, "", " ".join(f"token=abcdefgh{i:04d} é" for i in range(1200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df = df.withColumn("base", F.lit("clash")).withColumn("tokens", F.lit(1))
    scanned = secret_scan.scan(df, ["doc_id", "text"])
    got = scanned.withColumn("clean", secret_scan.redact(F.col("text"), F.col("base"))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert [(s.start, s.kind, s.end) for s in r.base] == want
        if want:
            clean, at = "", 0
            for a, _, b in want:
                if a >= at:
                    clean += texts[r.doc_id][at:a] + "[SECRET]"
                at = max(at, b)
            assert r.clean == clean + texts[r.doc_id][at:]
        else:
            assert r.clean == texts[r.doc_id]


def test_random_tokens_are_found_and_others_are_not(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(60)]
    plain = ["internationalization-and-localization-2024", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1",
             "counters-00001-00002-00003-00004-00005", "2024-01-01-2024-01-02-2024-01-03x"]
    rows = list(enumerate([f"see {k} now" for k in keys] + [f"see {p} now" for p in plain]))
    got = secret_scan.secret_scan(
        spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()
    found = {r.doc_id for r in got if r.spans}
    assert len(found & set(range(60))) >= 55
    assert not found & set(range(60, 64))
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert secret_scan.secret_scan(empty, ["doc_id"]).count() == 0


WORDS = ("get user element by id and update with retry python local share site packages module "
         "handler factory service config default value string buffer reader message queue index "
         "table customer order client server request response example release build version "
         "hotfix candidate internal common platform android windows session token stream").split()


def structured(rng):
    """Strings of code and configuration that hold letters and digits, by kind."""
    w = lambda k: [rng.choice(WORDS) for _ in range(k)]
    n = lambda: str(rng.randrange(1, 10 ** rng.randrange(1, 5)))
    camel = lambda k: "".join(x.capitalize() for x in w(k))
    return {
        "path": "/".join([*w(4), rng.choice(WORDS) + n(), *w(2)]),
        "class": "/".join(w(2)) + "/" + camel(2) + n() + camel(2) + "V" + n(),
        "camel": rng.choice(WORDS) + camel(4) + n() + camel(1),
        "snake": "_".join([*w(4), n()]),
        "version": "-".join([*w(3), "v" + n(), "rc" + n(), rng.choice(WORDS)]),
        "url": "https://example.com/" + "/".join([*w(3), n(), *w(2)]) + "?id=" + n(),
        "uuid": "-".join("%0*x" % (k, rng.randrange(16 ** k)) for k in (8, 4, 4, 4, 12)),
        "date": f"20{rng.randrange(10, 99)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}T"
                f"1{rng.randrange(9)}-2{rng.randrange(9)}-3{rng.randrange(9)}-{n()}Z",
    }


def test_structured_strings_are_no_secrets(spark):
    """Among ten times as many paths, identifiers, versions and links, fewer than 5 %
    of the added spans are false; recall by encoding and length."""
    rng = random.Random(12)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    random_kinds = {("base62", k): (lower + upper + digit, k) for k in (32, 40, 64, 100)}
    random_kinds |= {("base64", k): (lower + upper + digit + "+/", k) for k in (40, 64)}
    rows, kind_of = [], []
    for kind, (letters, k) in random_kinds.items():
        for _ in range(60):
            kind_of.append(kind)
            rows.append("".join(rng.choices(letters, k=k)))
    for _ in range(450):
        for kind, text in structured(rng).items():
            kind_of.append(kind)
            rows.append(text)
    df = spark.createDataFrame(list(enumerate(f"see {r} now" for r in rows)),
                               "doc_id bigint, text string")
    got = secret_scan.secret_scan(df, ["doc_id"]).collect()
    hit = [kind_of[r.doc_id] for r in got if any(s.kind == 3 for s in r.spans)]
    false = sum(k not in random_kinds for k in hit)
    recall = {k: hit.count(k) / 60 for k in random_kinds}
    assert false < 0.05 * len(hit), (false, len(hit))
    assert min(recall.values()) > 0.7, recall


# -- benchmark leaks ----------------------------------------------------------

def leak_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                                (text or "").lower()) if w]


def brute_leaks(docs, items, threshold=0.8):
    """Best similarity over all windows of the items' sizes, at every place."""
    bag = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    out = {}
    for d, text in docs:
        w = leak_words(text)
        for i, item in items:
            own = leak_words(item)
            if len(own) < 5:
                continue
            want = bag(own)
            for at in range(1 - len(own), len(w)):
                have = bag(w[max(0, at):at + len(own)])
                if have and sum((have & want).values()) >= threshold * sum(
                        (have | want).values()):
                    out.setdefault(d, set()).add(i)
                    break
    return {d: sorted(x) for d, x in out.items()}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, H.prose(rng, rng.randrange(20, 60), 300)) for i in range(12)]
    items += [(50, None), (51, ""), (52, "too short"), (3, items[3][1]), (60, items[4][1])]
    docs = []
    for i, (k, text) in enumerate(items[:12]):
        w = text.split()
        edit = list(w)
        edit[len(w) // 2] = "other"
        for body in (text, text.upper().replace(" ", ", "), " ".join(edit), " ".join(w[:-3]),
                     " ".join(w[:len(w) // 2])):
            docs.append(H.prose(rng, 30, 300) + " " + body + ". " + H.prose(rng, 20, 300))
        docs.append(text)
    docs += [H.prose(rng, 100, 300) for _ in range(20)] + [None, "", "a b"]
    docs = list(enumerate(docs))
    df = (spark.createDataFrame(docs + docs[:2], "doc_id bigint, text string").repartition(4)
          .withColumn("w", F.lit(1)).withColumn("item_ids", F.lit("clash")))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    leaks = decontam.decontaminate(df, bench)
    got = {r.doc_id: list(r.item_ids) for r in leaks.collect()}
    assert got == brute_leaks(docs, items)
    marked = decontam.mark(df, leaks)
    assert marked.count() == len(docs) + 2
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).count() == 0


def test_leaks_with_swapped_parts_equal_brute_force(spark):
    """The item's 5-grams stand at other offsets than in the item."""
    rng = random.Random(12)
    items = [(i, H.prose(rng, 40 + 5 * i, 300)) for i in range(8)]
    docs = []
    for _, text in items:
        w = text.split()
        for cut in (len(w) // 2, len(w) // 3):
            docs.append(" ".join([H.prose(rng, 30, 300), *w[cut:], *w[:cut],
                                  H.prose(rng, 20, 300)]))
        docs += [" ".join(w[k:] + w[:k]) for k in (7, len(w) // 2)]
        docs += [" ".join(w[k:]) + " " + H.prose(rng, 9, 300) for k in (2, 4, 6)]
    docs = list(enumerate(docs))
    want = brute_leaks(docs, items)
    assert len(want) >= 24
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontam.decontaminate(df, bench).collect()}
    assert got == want


def test_leaks_beyond_the_radius_are_found(spark):
    """Items with the longest head or tail replaced that keeps similarity 0.8."""
    rng = random.Random(13)
    items = [(i, H.prose(rng, 50, 5000)) for i in range(80)]
    docs = []
    for i, text in items:
        w = text.split()
        other = H.prose(rng, 5, 5000).split()
        docs += [(2 * i, " ".join(other + w[5:])), (2 * i + 1, " ".join(w[:-5] + other))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    prints = [{r[0]: r[1] for r in d.select(d.columns[0], decontam.simhash(
        decontam.word_hashes(F.col("text")))).collect()} for d in (df, bench)]
    far = [d for d, f in prints[0].items()
           if ((f ^ prints[1][d // 2]) & (1 << 64) - 1).bit_count() > decontam.RADIUS]
    assert far
    got = {r.doc_id: list(r.item_ids) for r in decontam.decontaminate(df, bench).collect()}
    assert got == {d: [d // 2] for d, _ in docs}


def test_large_benchmarks_take_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 0)
    item = H.prose(random.Random(1), 40, 300)
    df = spark.createDataFrame([(1, "x y " + item), (2, "z")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert [tuple(r[0::2]) for r in decontam.decontaminate(df, bench).collect()] == [(1, [9])]


def test_shuffled_five_grams_travel_without_the_words(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 0)
    rng = random.Random(3)
    item = H.prose(rng, 40, 300)
    text = " ".join([H.prose(rng, 1500, 300), item, H.prose(rng, 1500, 300), item])
    df = spark.createDataFrame([(1, text), (2, H.prose(rng, 3000, 300)), (None, text)],
                               "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    kind, sent = type(df), []
    join = kind.join

    def record(self, other, on=None, how=None):
        if isinstance(on, str) and on == "shingle":
            sent.append(self.columns)
        return join(self, other, on, how)
    monkeypatch.setattr(kind, "join", record)
    got = [(r.doc_id, list(r.item_ids)) for r in decontam.decontaminate(df, bench).collect()]
    assert sorted(got, key=str) == [(1, [9]), (None, [9])]
    assert sent == [["doc_id", "text_hash", "i", "shingle"]]


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    """Any RADIUS changed bits leave one block whole."""
    rng = random.Random(6)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        pairs.append([x - (1 << 64) if x >> 63 else x for x in (a, b)])
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a bigint, b bigint")
    one = df.select("i", decontam._blocks(F.col("a")).alias("x"))
    two = df.select("i", decontam._blocks(F.col("b")).alias("x"))
    assert one.join(two, ["i", "x"]).select("i").distinct().count() == 200


# -- quality classifier -------------------------------------------------------

def test_classifier_learns_and_covers_whole_texts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        good = i % 2
        words = [H.prose(rng, 1) + ("" if good else "%%%") for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(words), good))
    df = spark.createDataFrame([r[:2] for r in rows] + [(900, ""), (901, None), (902, "é")],
                               "doc_id bigint, text string")
    df = df.withColumn("quality", F.lit(1)).withColumn("score", F.lit(7.0)).repartition(3)
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows],
                                   "doc_id bigint, quality int, toxic int")
    texts, y = quality_cnn.training_rows(df.drop("quality"), labels, 50)
    assert len(texts) <= 100 and set(y) == {0, 1}
    model = quality_cnn.fit(texts, y)
    got = {r.doc_id: r.score for r in quality_cnn.score(df, model).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[r[0]] >= 0.3) == bool(r[2]) for r in rows) >= 0.95 * len(rows)
    # The end of a long text counts: chunks cover all of it.
    long = b"w1 w2 w3 " * 3000
    both = long + b"w1%%% w2%%% " * 3000
    data = np.frombuffer(long + both, np.uint8)
    a, b = model.score(data, np.array([0, len(long), len(long) + len(both)]))
    assert a - b > 0.01


def test_classifier_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in quality_cnn.classify(df, none).collect()] == [0.5, 0.5]
    assert quality_cnn.classify(df.limit(0), none).count() == 0


def test_held_out_fold(spark):
    import zlib
    df = spark.range(200).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r.h for r in df.select("doc_id", quality_cnn.held_out(F.col("doc_id"))
                                            .alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())


def naive_features(model, text):
    """Every window of a text by itself, in plain loops."""
    E, W, c = (model.p[k].astype(float) for k in ("E", "W", "c"))
    values = [*text, *[256] * quality_cnn.WIDTH]
    out = np.zeros(quality_cnn.FILTERS)
    for at in range(0, len(text), quality_cnn.CHUNK):
        size = min(quality_cnn.CHUNK, len(text) - at)
        best = np.full(quality_cnn.FILTERS, -np.inf)
        for i in range(at, at + size):
            window = np.concatenate([E[values[i + j]] for j in range(quality_cnn.WIDTH)])
            best = np.maximum(best, window @ W + c)
        out += np.maximum(best, 0) * size / len(text)
    return out


def _small_model(seed):
    model = quality_cnn.Model(np.random.default_rng(seed))
    model.p["c"] += np.linspace(-0.2, 0.2, quality_cnn.FILTERS).astype(np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    return model


def _joined(texts):
    return (np.frombuffer(b"".join(texts), np.uint8),
            np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def test_convolution_equals_naive_loops():
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 5, 255, 256, 257, 700, 0, 12)]
    model = _small_model(1)
    got = model.score(*_joined(texts))
    for text, score in zip(texts, got):
        z = (naive_features(model, text) @ model.p["v"] + model.p["b"])[0] if text else model.p["b"][0]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_gradients_equal_finite_differences():
    texts = [b"good clear prose here", b"buy now!!! $$$ cheap", b"x", b"another line of text" * 20]
    y, weight = np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 1, 0.5])
    model, data = _small_model(2), _joined(texts)

    def loss():
        p = model.score(*data)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    grads, rng = model.gradients(*data, y, weight), np.random.default_rng(0)
    for k, g in grads.items():
        flat = model.p[k].reshape(-1)
        large = np.argsort(-np.abs(g.reshape(-1)))[:3]
        for i in [*large, *rng.integers(0, 256 if k == "E" else flat.size, 3)]:
            was, step, found = flat[i], 1e-3, []
            for s in (step, -step):
                flat[i] = was + s
                found.append(loss())
            flat[i] = was
            assert g.reshape(-1)[i] == pytest.approx((found[0] - found[1]) / (2 * step), abs=2e-3)
