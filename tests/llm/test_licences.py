from tonelake.llm import licences

PLANTED = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "All rights reserved.": "proprietary",
}


def test_planted_lines(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = licences.scan(docs).collect()
    want = sum(line in PLANTED for r in docs.collect() for line in r.text.split("\n"))
    hits = [r for r in got if r.text in PLANTED]
    assert want > 20 and len(hits) == want
    assert all(r.family == PLANTED[r.text] and r.confirmed for r in hits)
    assert sum(r.confirmed for r in got if r.text not in PLANTED) == 0


def test_families_variants_and_unknown(spark):
    rows = [(i, t) for i, (_, t) in enumerate(licences.TEMPLATES)]
    rows += [(100, "Released, kindly, under the MIT License by its authors"), (101, "My licence to drive is new and the license plate is old"), (102, "Permission was asked and the warranty ended"), (103, None), (104, ""), (None, "All rights reserved."), (105, "All rights reserved."), (105, "All rights reserved."), (106, "word and word. " * 20_000 + "Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame([(d, t, "f", 0.5) for d, t in rows], "doc_id long, text string, family string, p double")
    got = licences.scan(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    right = sum(any(r.family == f and r.confirmed for r in by.get(i, [])) for i, (f, _) in enumerate(licences.TEMPLATES))
    assert right >= len(licences.TEMPLATES) - 1
    assert by[100][0].family == "mit" and by[None][0].family == "proprietary" and len(by[105]) == 2
    assert 101 not in by and 102 not in by  # they state no licence
    assert by[106][0].family == "cc-by" and by[106][0].confirmed
    assert 103 not in by and 104 not in by
    assert licences.scan(docs.limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_notices_and_other_languages(spark):
    stated = [("mit", MIT), ("bsd", BSD), ("gpl", GPL), ("cc-by", "Available under CC BY 4.0."), ("gpl", "Dieses Programm steht unter der GNU General Public License, Version 3."), ("gpl", "GPLv3 or later"), ("mit", "Publicado bajo la licencia MIT."), ("proprietary", "Tous droits réservés.")]
    docs = spark.createDataFrame([(i, "A first line without a stop\n\n" + t + "\n\nThe last line of the text.") for i, (_, t) in enumerate(stated)], "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in licences.scan(docs).collect() if r.confirmed}
    assert got == {(i, f) for i, (f, _) in enumerate(stated)}


def test_texts_that_training_has_not_seen(spark):
    named = [(i, f, t) for i, (f, t) in enumerate(UNSEEN)]
    docs = spark.createDataFrame([(i, t) for i, _, t in named], "doc_id long, text string")
    family = {r.doc_id: r.family for r in licences.scan(docs).collect()}
    stated = [(i, f) for i, f, _ in named if f]
    assert sum(family.get(i) == f for i, f in stated) >= 0.8 * len(stated)
    assert sum(i in family for i, f, _ in named if not f) <= 0.2 * (len(named) - len(stated))


#: Not in the module: statements with their family, and sentences that state none.
UNSEEN = [
    ("mit", "The examples are released under the terms of the MIT License."), ("apache-2.0", "This module is licensed under the Apache License, Version 2.0, like the rest."), ("gpl", "The driver is licensed under the GNU General Public License, version 2."), ("bsd", "The fonts are licensed under the BSD 3-Clause License, too."), ("mpl-2.0", "Our files are licensed under the Mozilla Public License 2.0."),
    ("cc-by-sa", "The drawings are licensed under CC BY-SA 4.0, as before."), ("proprietary", "Copyright 2004 the editors. All rights reserved."), ("lgpl", "That library is licensed under the GNU Lesser General Public License, version 3."), ("agpl", "Licensed under the GNU Affero General Public License, version 3 or later."), ("isc", "The script is released under the ISC License."),
    (None, "The pilot lost his license after the storm."), (None, "A warranty is of little use here."), (None, "They gave us permission to cross the field."), (None, "Copyright was the topic of the evening."), (None, "The public library opens at nine."), (None, "Version 2.0 of the bridge is wider."), (None, "Die Lizenz zum Angeln kostet zehn Euro."), (None, "Il a perdu son permis de conduire."), (None, "La biblioteca pública abre a las nueve."), (None, "Software and hardware are sold on the second floor."),
]


def test_main_path_runs_no_python(spark, sf_dir):
    plan = licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
