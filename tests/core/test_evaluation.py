import json

from attesta.operators import evaluation as el

PAIRS = [
    ("p1", True, {"name": "Alpha Clínica Ltda", "registry_id": "11.111.111/0001-11"}, {"name": "Alpha", "registry_id": "11111111000111"}),
    ("p2", False, {"name": "Beta Saúde", "registry_id": "22222222000122", "domain": "beta.com"}, {"name": "Beta Saúde", "registry_id": "33333333000133", "domain": "beta.com"}),
    ("p3", True, {"name": "Gama Dental", "domain": "https://www.gama.com/a"}, {"name": "Gama Dental SA", "domain": "gama.com"}),
    ("p4", True, {"name": "Delta Odonto", "city": "Recife", "state": "PE"}, {"name": "D. O. Serviços", "city": "Recife", "state": "PE"}),
    ("p5", False, {"name": "Épsilon", "phone": "(11) 2222-3333"}, {"name": "Zeta Hospitalar", "phone": "+55 11 99999-0000"}),
]


def test_a_labelled_file_gives_the_same_counts_again(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps([{"id": i, "label": y, "category": "c", "left": a, "right": b} for i, y, a, b in PAIRS], ensure_ascii=False))
    rows = el.read(spark, str(path))
    got = {(r.strategy, r.threshold): (r.tp, r.fp, r.tn, r.fn) for r in el.company_report(rows, (0.7, 0.96)).collect()}
    assert got["REGISTRY_ONLY", None] == (1, 0, 2, 2)
    assert got["EXACT_EVIDENCE", None][:2] == (1, 0) or got["EXACT_EVIDENCE", None][:2] == (2, 0)
    assert all(sum(v) == 5 for v in got.values()) and got["WEIGHTED", 0.7][0] >= got["WEIGHTED", 0.96][0]
    triage = {r.disposition: (r.duplicates, r.negatives) for r in el.company_triage(rows).collect()}
    assert triage["AUTO_MATCH"] == (1, 0) and triage["DISTINCT"] == (0, 1) and sum(a + b for a, b in triage.values()) == 5
    blocking = el.company_blocking(rows).first()
    assert blocking.total_pairs == 45 and blocking.true_duplicate_pairs == 3 and 2 <= blocking.candidate_duplicate_pairs <= 3
