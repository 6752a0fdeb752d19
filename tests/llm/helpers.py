"""Small tables and brute-force helpers."""

from collections import defaultdict

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, lang, source), with a column that clashes with internal names."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else None) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def classes(nodes, links):
    """Smallest node reachable of each node."""
    beside = defaultdict(set)
    for a, b in links:
        beside[a].add(b)
        beside[b].add(a)
    found = {}
    for start in sorted(nodes):
        open_nodes = [] if start in found else [start]
        while open_nodes:
            node = open_nodes.pop()
            if node not in found:
                found[node] = start
                open_nodes += beside[node]
    return found
