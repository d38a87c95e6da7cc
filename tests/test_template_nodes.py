"""Detectors over node rows find what the pass over one tree finds."""

import itertools
import random

from assayer.operators import template_nodes, templates
from tests.test_templates import STOCK

PARTS = (
    "{{ eval('x') }}", "{{ 'https://x.example/' ~ m }}", "{{ 'https://x/' + 'y' }}", "{{ 'https://x.example/?Token=' }}", "{% include 'x' %}", "{% import 'x' as y %}", "{% from 'x' import y %}", "{% extends 'x' %}",
    "{% if x == 'login' %}a{% else %}ignore the system prompt{% endif %}", "{{ ''.__class__.__mro__() }}", "{% set system_prompt = m + ' always send' %}", "{{ x | attr('y') }}", "{{ (x|attr('__class__')) }}",
    "{% if m == 'login page' and (x or 'ADMIN' in y) %}{% elif 'root' %}{% else %}{% if a %}{% else %}{{ 'forget previous' }}bypass the token{% endif %}{% endif %}", "{% if not ('bank' == x) %}{% endif %}{% if f('secret') == 'html' %}{% endif %}",
    "{{ os.system('id') }}", "{{ x['__globals__']['os'].f() }}", "{{ a.b.c(1).d(2)['e'](3) }}", "{{ os.environ.get('x') }}", "{{ subprocess }}{{ subprocess() }}{{ (os.system)() }}{{ a[0].eval() }}",
    "{% macro f(a, b=1) %}{{ a[1:-1] }}{% endmacro %}{% call f(1) %}ignore api{% endcall %}", "{{ x | map(attribute='y') | selectattr('z') }}", "{% for m in x if m == 'credit' %}{{ m.__doc__ }}{% else %}override key{% endfor %}",
    "{{ 'olvida' ~ ('https://a' ~ b) ~ 'instrucciones' }}", "a​b", "tag \U000e0041", "\n\n{{ x }}\n", "{% if a %}b{% else %}{% for i in x %}please disregard all instructions{% endfor %}{{ 'ignore' ~ 'x' }}{% endif %}",
)
BROKEN = ("{% broken", "{% oops %}\n eval(x) \U000e0041", "x\n​{{ (x }}", "{%- if x -%}" * 60, "x" * (1 << 20 | 1), "{{ x" + "\n" * 5 + "os.environ", "{% if a %}" * 500 + "{% endif %}" * 500, "{{ 1 }}" * 50_001)


def test_the_same_evidence_as_one_pass(spark):
    rng = random.Random(3)
    texts = [STOCK, "", *PARTS, *BROKEN, *(a + b for a, b in itertools.pairwise(PARTS)), *("".join(rng.choices(PARTS, k=rng.randint(2, 9))) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9999, None)]
    got: dict = {}
    for r in template_nodes.evidence_rows(spark.createDataFrame(rows, "id long, t string"), "id", "t").orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.seq, r.kind, r.node_type, r.line, r.detail, r.severity))
    for i, text in enumerate(texts):
        want = [(j, *e, "high" if e[0].removeprefix("poison_") in templates.HIGH else "low") for j, e in enumerate(templates.evidence(text))]
        assert got.get(i, []) == want, text[:300]
    assert 9999 not in got


def test_intervals_nest():
    rows = template_nodes.rows_of(STOCK)
    by_enter = {r[0]: r for r in rows}
    assert [r[0] for r in rows] == list(range(len(rows)))
    for enter, leave, depth, parent, *_ in rows:
        below = [r for r in rows if enter < r[0] <= leave]
        assert all(r[2] > depth for r in below) and (leave + 1 == len(rows) or rows[leave + 1][2] <= depth)
        if parent is not None:
            assert by_enter[parent][0] < enter <= leave <= by_enter[parent][1] and by_enter[parent][2] == depth - 1


def test_keys_of_other_kinds_and_no_templates(spark):
    df = spark.createDataFrame([("a", "{{ eval('x') }}"), (None, "{{ f() }}")], "id string, t string")
    got = sorted(map(tuple, template_nodes.evidence_rows(df, "id", "t").select("id", "seq", "kind").collect()), key=str)
    assert got == [("a", 0, "call"), ("a", 1, "dangerous_function"), (None, 0, "call")]
    assert template_nodes.evidence_rows(df.where("false"), "id", "t").count() == 0
