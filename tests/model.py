"""A literal, record-at-a-time model of assembly, for tests only."""

import re


def parse(payload):
    text = payload[len("track ") :]
    found = re.match(r"[0-9]+ (?=.)", text, re.DOTALL)
    if found:
        text = text[found.end() :]
    return ("key", text[4:]) if text.startswith("key ") else ("data", text)


def assemble(records, max_reclen, maxkeylen, fallback=(0, 0)):
    """records: (tx_seq, rec_seq, vxid, tag, payload) of one group that pass the filters. Returns a dict."""
    size = lambda s: len(s.encode())
    out = {"outcome": "nodata", "truncated": 0, "key_overflows": 0, "vsl_err": 0, "key": "", "key_hi": 0, "no_timestamp": False, "data": None}
    text, latest, has_data = None, (0, 0), False
    for _, _, vxid, tag, payload in sorted(records):
        if text is None:
            text = f"XID={vxid}"
            end = size(text)
        if tag == "VSL":
            out["vsl_err"] += 1
        elif tag == "Timestamp":
            m = re.match(r"Resp: ([0-9]{1,10})\.([0-9]{6}) ", payload)
            if m:
                latest = max(latest, (int(m[1]), int(m[2])))
        else:
            kind, body = parse(payload)
            if kind == "key":
                if size(body) > maxkeylen:
                    out["key_overflows"] += 1
                else:
                    out["key"], out["key_hi"] = body, max(out["key_hi"], size(body))
            else:
                if end + size(body) + 1 > max_reclen:
                    return out | {"outcome": "len_overflow", "len_hi": end}
                cut = body.split("\0", 1)[0]
                out["truncated"] += cut != body
                text, end, has_data = f"{text}&{cut}", end + size(cut) + 1, True
    out["len_hi"] = end
    if not has_data:
        return out
    if latest[0] == 0:
        latest, out["no_timestamp"] = fallback, True
    if end + 27 > max_reclen:
        return out | {"outcome": "len_overflow"}
    return out | {"outcome": "submitted", "len_hi": end + 27, "data": f"{text}&req_endt={latest[0]}.{latest[1]:06d}"}
