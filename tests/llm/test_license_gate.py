"""Each license rule on texts that hold nothing but its own match."""

import re
import re._constants as sre
import re._parser

from prismrank.llm import licenses


def example(tree, branch, most):
    """A match of an expression: the branch of that number, optional parts only with most."""
    out = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.IN:
            kind, x = arg[branch]
            out += chr(x if kind is sre.LITERAL else x[0])
        elif op is sre.SUBPATTERN:
            out += example(arg[3], branch, most)
        elif op is sre.BRANCH:
            out += example(arg[1][branch], branch, most)
        elif op is sre.MAX_REPEAT:
            out += example(arg[2], branch, most) * (max(arg[0], 1) if most else arg[0])
        else:
            raise ValueError(op)
    return out


def test_each_rule_finds_its_own_match(spark):
    rows = []
    for rule in licenses.signature_rules():
        for branch, most in ((0, False), (-1, False), (-1, True)):
            text = example(re._parser.parse(rule.pattern), branch, most)
            assert re.fullmatch(rule.pattern, text)
            rows.append((len(rows), rule.label, text.title().replace(" ", ",\n ")))
    docs = spark.createDataFrame(rows, "doc_id long, label string, text string").repartition(8)
    found = {r["doc_id"]: {x["label"] for x in r["found"]} for r in licenses.scan(docs).select("doc_id", "found").collect()}
    missed = [(label, text) for i, label, text in rows if label not in found[i]]
    assert not missed, missed[:10]


def test_names_without_the_word_license(spark):
    texts = {"Released under Apache 2.0": "apache-2.0", "GPL v3": "gpl-3", "BSD 3-Clause": "bsd-3-clause", "MPL 2.0": "mpl-2.0", "CC BY-SA 4.0": "cc-by-sa-4.0", "Creative Commons Attribution 4.0": "cc-by-4.0", "CC0 1.0": "cc0", "(GPL v2)": "gpl-2", "ein Haus mit 2 Türen": "", "subgpl 3": ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.scan(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
