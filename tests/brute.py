"""Sequential versions of the operators, on lists of dictionaries."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict


class Num(str):
    pass


def loads_raw(text):
    return json.loads(text, parse_int=Num, parse_float=Num)


def token(text):
    if text is None:
        return None
    m = re.search(r'"_data"\s*:\s*"([0-9A-Fa-f]+)"', text) or re.fullmatch(r"\s*([0-9A-Fa-f]+)\s*", text)
    return m[1].upper() if m else None


def pending(oplog, changes, runs):
    landed = {}
    by_token = {}
    for r in oplog:
        k = (r["shard"], "OPLOG", r["ts"]["t"], r["ts"]["i"])
        landed[k] = min(landed.get(k, r["landed_at"]), r["landed_at"])
    for r in changes:
        if r["cluster_time"] is None:
            continue
        at = (r["cluster_time"]["t"], r["cluster_time"]["i"])
        k = (r["shard"], "CHANGE_STREAM", *at)
        landed[k] = min(landed.get(k, r["landed_at"]), r["landed_at"])
        if token(r["_id"]):
            by_token[token(r["_id"])] = at

    def position(mode, text):
        if text is None:
            return None
        if mode == "CHANGE_STREAM":
            return by_token[token(text)]
        if text.strip().startswith("{"):
            x = json.loads(text)["$timestamp"]
            return (x["t"], x["i"])
        return tuple(map(int, text.split(":")))

    last = {}
    for r in sorted(runs, key=lambda r: r["logged_at"]):
        last[(r["shard"], r["capture_mode"], r["run_id"])] = r
    spans = defaultdict(list)
    for (shard, mode, _), r in last.items():
        if r["run_state"] == "COMMITTED":
            spans[shard, mode].append((position(mode, r["start_offset"]) or (-1, -1), position(mode, r["end_offset"]), r["read_at"]))
    return {k for k, at in landed.items() if not any(lo < k[2:] <= hi and at <= read for lo, hi, read in spans[k[:2]])}


def tagged(v):
    return isinstance(v, dict) and len(v) == 1 and next(iter(v)).startswith("$")


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def diff(a, b, prefix=""):
    for k in sorted(a.keys() | b.keys()):
        if k not in a or k not in b:
            yield prefix + k
        elif isinstance(a[k], dict) and isinstance(b[k], dict) and not tagged(a[k]) and not tagged(b[k]):
            yield from diff(a[k], b[k], prefix + k + ".")
        elif not same(a[k], b[k]):
            yield prefix + k


def differences(source, target, ns_map):
    back = {r["target_ns"]: r["source_ns"] for r in ns_map}
    s = {(r["ns"], r["_id"], r["id_type"]): r["doc"] for r in source}
    t = {(back.get(r["ns"], r["ns"]), r["_id"], r["id_type"]): r["doc"] for r in target}
    out = set()
    for k in s.keys() | t.keys():
        if k not in t:
            out.add((*k, "missingOnTarget", ""))
        elif k not in s:
            out.add((*k, "missingOnSource", ""))
        else:
            a, b = ({x: v for x, v in json.loads(d).items() if x not in ("_class", "updatedAt")} for d in (s[k], t[k]))
            out |= {(*k, "contentMismatch", p) for p in diff(a, b)}
    return out


def current(events):
    docs, seen = {}, set()
    for e in sorted(events, key=lambda e: (e["phase"], e["ts_t"], e["ts_i"], e["seq"])):
        if (e["ts_t"], e["ts_i"]) in seen:
            continue
        seen.add((e["ts_t"], e["ts_i"]))
        before, after = (loads_raw(e[c]) if e[c] else None for c in ("before_doc", "after_doc"))
        key = next((d["_id"] for d in (before, after) if d and d.get("_id") is not None), None)
        if key is None:
            continue
        key = (e["ns"], str(key))
        if e["op"] == "d":
            docs.pop(key, None)
        elif e["op"] in ("c", "r") or e["op"] == "u" and after is not None and not any(k.startswith("$") for k in after):
            docs[key] = after
        elif e["op"] == "u" and after is not None:
            puts, drops = after.get("$set") or {}, after.get("$unset") or {}
            if not puts and not drops:
                continue
            doc = docs.setdefault(key, {})
            for path, v in puts.items():
                *up, last = path.split(".")
                d = doc
                for p in up:
                    if not isinstance(d.get(p), dict):
                        d[p] = {}
                    d = d[p]
                d[last] = json.loads(json.dumps(v)) if isinstance(v, dict) and False else v
            for path in drops:
                *up, last = path.split(".")
                d = doc
                for p in up:
                    d = d.get(p) if isinstance(d, dict) else None
                if isinstance(d, dict):
                    d.pop(last, None)
    out = set()

    def walk(key, d, prefix=""):
        for k, v in d.items():
            if prefix + k == "_id":
                continue
            if isinstance(v, dict):
                walk(key, v, prefix + k + ".")
            elif not isinstance(v, list):
                out.add((*key, prefix + k, "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)))

    for key, d in docs.items():
        walk(key, d)
    return out


def repeats(events):
    once = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        once.setdefault((e["ts_t"], e["ts_i"]), e)
    by = defaultdict(list)
    for at, e in sorted(once.items()):
        if e["op"] in ("c", "u") and e["after_doc"] and (d := json.loads(e["after_doc"])).get("acct") is not None:
            by[d["acct"]].append((at, d.get("qty")))
    return {(a, *y[0]) for a, xs in by.items() for x, y in zip(xs, xs[1:]) if y[1] is not None and x[1] == y[1]}


TAGS = {"$oid": "objectId", "$date": "date", "$numberDecimal": "decimal"}


def kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else TAGS[next(iter(v))]


def flat(d, prefix=""):
    for k, v in d.items():
        if isinstance(v, dict) and not tagged(v):
            yield from flat(v, prefix + k + ".")
        else:
            yield prefix + k, v


def drift(entries):
    lowest = {}
    for e in entries:
        k = (e["shard"], e["ts"]["t"], e["ts"]["i"])
        lowest[k] = min(lowest.get(k, e["file_no"]), e["file_no"])
    docs, taken = defaultdict(dict), set()
    for e in sorted(entries, key=lambda e: (e["ts"]["t"], e["ts"]["i"], e["entry_id"])):
        k = (e["shard"], e["ts"]["t"], e["ts"]["i"])
        if lowest[k] != e["file_no"] or k in taken:
            continue
        taken.add(k)
        db, _, coll = e["ns"].partition(".")
        if e["op"] not in ("i", "u") or db == "config" or coll.startswith("system.") or coll == "$cmd":
            continue
        o = json.loads(e["o"])
        if e["op"] == "i" or not any(x.startswith("$") for x in o):
            docs[e["shard"], e["ns"], "o"].setdefault(e["file_no"], []).append(o)
        if e["op"] == "u" and e["o2"]:
            docs[e["shard"], e["ns"], "o2"].setdefault(e["file_no"], []).append(json.loads(e["o2"]))
    out = set()
    for key, files in docs.items():
        numbers = sorted(files)
        for a, b in zip(numbers, numbers[1:]):
            types = []
            for n in (a, b):
                t = defaultdict(Counter)
                for d in files[n]:
                    for p, v in flat(d):
                        t[p][kind(v)] += 1
                types.append({p: next((x for x, _ in sorted(c.items(), key=lambda x: (-x[1], str(x[0]))) if x is not None), None) for p, c in t.items()})
            gone, new = sorted(types[0].keys() - types[1].keys()), sorted(types[1].keys() - types[0].keys())
            for p in gone:
                for q in new:
                    old = {json.dumps(d["_id"], sort_keys=True): dict(flat(d)).get(p) for d in files[a]}
                    now = defaultdict(list)
                    for d in files[b]:
                        now[json.dumps(d["_id"], sort_keys=True)].append(dict(flat(d)).get(q))
                    pairs = [(v, w) for i, v in old.items() if v is not None for w in now.get(i, [])[:1]]
                    if pairs and all(same(v, w) for v, w in pairs):
                        out.add((*key, b, "renamed", p, q))
                        gone = [x for x in gone if x != p]
                        new = [x for x in new if x != q]
                        break
            out |= {(*key, b, "removed", p, "") for p in gone} | {(*key, b, "added", p, "") for p in new}
            out |= {(*key, b, "retyped", p, "") for p in types[0].keys() & types[1].keys() if types[0][p] and types[1][p] and types[0][p] != types[1][p]}
    return out


def copies(rows):
    root = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = {}
    for r in sorted(rows, key=lambda r: r["delivery_id"]):
        d = r["delivery_id"]
        root[d] = d
        names = []
        if token(r["_id"]):
            names.append(("t", token(r["_id"])))
        if None not in (r["shard"], r["cluster_time"], r["ns"], r["document_key"]):
            names.append(("k", r["shard"], r["cluster_time"]["t"], r["cluster_time"]["i"], r["ns"], json.dumps(json.loads(r["document_key"]), sort_keys=True)))
        for n in names:
            other = first.setdefault(n, d)
            a, b = find(other), find(d)
            if a != b:
                root[max(a, b)] = min(a, b)
    return {d for d in root if find(d) != d}
