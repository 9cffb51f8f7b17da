"""DuckDB SQL for the queries over models and evaluation."""

from __future__ import annotations

from ..sources.datasets import FAMILIES, KDD, KDD_FLAGS, KDD_LOG, KDD_PROTOCOLS, KDD_TEXT, UNSW
from .flow_oracle import FE, FQ

FD = """fd AS (SELECT d.doc_id AS id, l.quality AS y, l.toxic AS y2, CAST(d.n_chars AS DOUBLE) AS f1, CAST(length(regexp_replace(d.text,'[^0-9]','','g')) AS DOUBLE) AS f2 FROM documents d JOIN labels l ON d.doc_id=l.doc_id),
sc AS (SELECT *, floor(log10(f1+1)*20)/100 AS score FROM fd)"""
BINARY = "tp AS (SELECT y, CAST(score>=0.6::DOUBLE AS INT) AS said, count(*) AS n FROM sc GROUP BY ALL)"
_CLASS = f"""{FD}, {BINARY}, cl AS (SELECT cls, coalesce(sum(n) FILTER (y=cls AND said=cls),0) AS tp, coalesce(sum(n) FILTER (y<>cls AND said=cls),0) AS fp, coalesce(sum(n) FILTER (y=cls AND said<>cls),0) AS fn FROM tp, (VALUES (0),(1)) v(cls) GROUP BY cls), pc AS (
SELECT CAST(cls AS INT) AS cls, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp+fp>0 THEN tp/(tp+fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp+fn>0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn)::DOUBLE ELSE 0 END AS f1 FROM cl WHERE tp+fp+fn>0)"""
_C = lambda n: "1.0::DOUBLE" if n <= 1 else f"(2*(ln({n}-1)+0.5772156649015329::DOUBLE)-2*({n}-1)/{n}::DOUBLE)"

_KNOWN = ", ".join(f"('{x}','{k}')" for k, xs in FAMILIES.items() for x in xs)



def _weighed(numbers: list[str], logs: tuple[str, ...], kinds: list[int]) -> str:
    """Each component times its place, summed: numbers first, then the places of the one-hot values."""
    x = lambda i: f"CAST((k+{i})%50 AS DOUBLE)"
    parts = [f"{i + 1}*{f'log10({x(i)}+1)' if n in logs else x(i)}" for i, n in enumerate(numbers)]
    at = len(numbers)
    for n in kinds:
        parts.append(f"({at + 1}+k%{n})")
        at += n
    return f"SELECT event_id AS seq, {at} AS n, round({' + '.join(parts)}, 6) AS weighed FROM (SELECT event_id, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events) e"


ORACLE = {
    "nsl_vec": _weighed([n for n in KDD if n not in KDD_TEXT], KDD_LOG, [len(KDD_PROTOCOLS), len(KDD_FLAGS)]),
    "unsw_vec": _weighed(UNSW, ("dur", "sbytes", "dbytes", "rate", "sload", "dload"), [3, 4]),
    "category_map": f"SELECT * FROM (VALUES {_KNOWN}, ('Normal','normal'), (' neptune ','dos'), ('unheard','other')) v(attack, category)",
    "model_manifest": "SELECT * FROM (VALUES ('example','ok'), ('weights','ok'), ('missing','missing')) v(name, state)",
    "netflow_decode": f"WITH {FE} SELECT round(1757900000 - 100 + seq/100::DOUBLE, 3) AS ts, src_ip, dst_ip, src_port, dst_port, proto, round(duration, 3) AS duration, pkts_out, bytes_out, CASE WHEN proto='tcp' THEN 1 ELSE 0 END AS syn, CASE WHEN proto='tcp' THEN synack ELSE 0 END AS synack, 0 AS rst, 0 AS fin FROM fe",
    "packet_decode": f"WITH {FQ} SELECT round(seq + h*0.02::DOUBLE, 3) AS ts, CASE h WHEN 0 THEN src_ip ELSE dst_ip END AS src_ip, CASE h WHEN 0 THEN dst_ip ELSE src_ip END AS dst_ip, CAST(CASE h WHEN 0 THEN 1024+seq%60000 ELSE 53 END AS INT) AS src_port, CAST(CASE h WHEN 0 THEN 53 ELSE 1024+seq%60000 END AS INT) AS dst_port, 'udp' AS proto, dns_qname FROM fq, range(2) r(h) WHERE dns_qname<>''",
    "flow_assembly": f"WITH {FQ} SELECT round(seq::DOUBLE, 3) AS ts, src_ip, dst_ip, CAST(1024+seq%60000 AS INT) AS src_port, 53 AS dst_port, 'udp' AS proto, CAST(1 AS BIGINT) AS pkts_out, CAST(1 AS BIGINT) AS pkts_in, dns_qname, dns_qtype, dns_rcode FROM fq WHERE dns_qname<>''",
    "lr_scaler": f"WITH {FD} SELECT round(avg(f1),4) AS mu_f1, round(CASE WHEN stddev_samp(f1)=0 THEN 1 ELSE stddev_samp(f1) END,4) AS sigma_f1, round(avg(f2),4) AS mu_f2, round(CASE WHEN stddev_samp(f2)=0 THEN 1 ELSE stddev_samp(f2) END,4) AS sigma_f2 FROM fd",
    "lr_threshold": f"WITH {FD}, g AS (SELECT i/100::DOUBLE AS t FROM range(5,100,2) r(i)), h AS (SELECT t, count(*) FILTER (y=1 AND score>=t) AS tp, count(*) FILTER (y=0 AND score>=t) AS fp, count(*) FILTER (y=1 AND score<t) AS fn FROM sc, g GROUP BY t) SELECT t, tp, fp, fn, round(CASE WHEN tp>0 THEN 2*tp/(2*tp+fp+fn)::DOUBLE END,6) AS f1 FROM h",
    "temporal_split": f"WITH {FD} SELECT id, row_number() OVER (ORDER BY f1, id) <= floor(count(*) OVER () * 0.7::DOUBLE) AS train FROM sc",
    "calibration_fit": f"WITH {FD}, r AS (SELECT score, y, row_number() OVER (ORDER BY score, y) AS rn, greatest(count(*) OVER ()//10,1) AS sz FROM sc), b AS (SELECT (rn-1)//sz AS bin, min(score) AS edge, (sum(y)+1)/(count(*)+2)::DOUBLE AS v FROM r GROUP BY 1) SELECT bin, round(edge,6) AS edge, round(max(v) OVER (ORDER BY bin),6) AS value FROM b",
    "confusion": f"WITH {FD}, {BINARY} SELECT y, said, n FROM tp",
    "prf_macro": f"WITH {_CLASS} SELECT cls, tp, fp, fn, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM pc",
    "macro_f1": f"WITH {_CLASS} SELECT round(avg(f1),6) AS macro_f1 FROM pc",
    "binary_metrics": f"WITH {FD}, k AS (SELECT count(*) FILTER (y=1 AND score>=0.6::DOUBLE) AS tp, count(*) FILTER (y=0 AND score>=0.6::DOUBLE) AS fp, count(*) FILTER (y=0 AND score<0.6::DOUBLE) AS tn, count(*) FILTER (y=1 AND score<0.6::DOUBLE) AS fn FROM sc) SELECT tp, fp, tn, fn, round((tp+tn)/(tp+fp+tn+fn)::DOUBLE,6) AS accuracy, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp)::DOUBLE ELSE 0 END,6) AS precision, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END,6) AS recall, round(CASE WHEN tp>0 THEN 2*tp/(2*tp+fp+fn)::DOUBLE ELSE 0 END,6) AS f1, round(CASE WHEN fp+tn>0 THEN fp/(fp+tn)::DOUBLE ELSE 0 END,6) AS fpr FROM k",
    "ece_brier": f"WITH {FD}, b AS (SELECT least(floor(score*10),9) AS b, count(*) AS n, avg(score) AS conf, avg(y) AS acc, sum((score-y)*(score-y)) AS sq FROM sc GROUP BY 1) SELECT round(sum(n*abs(conf-acc))/sum(n),6) AS ece, round(sum(sq)/sum(n),6) AS brier FROM b",
    "recall_at_fpr": f"WITH {FD}, n AS (SELECT score, row_number() OVER (ORDER BY score)-1 AS i, count(*) OVER () AS n FROM sc WHERE y=0), t AS (SELECT score AS threshold FROM n WHERE i=least(CAST(round_even((1.0::DOUBLE-0.1::DOUBLE)*n,0) AS BIGINT),n-1)) SELECT round(max(threshold),6) AS threshold, round(avg(CASE WHEN score>threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS recall FROM sc, t WHERE y=1",
    "auc": f"WITH {FD}, w AS (SELECT a.score AS p, b.score AS n FROM sc a, sc b WHERE a.y=1 AND b.y=0) SELECT round(avg(CASE WHEN p>n THEN 1.0::DOUBLE WHEN p=n THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END),6) AS auc FROM w",
    "host_truth": f"WITH {FE}, l AS (SELECT CASE WHEN seq%5=0 THEN src_ip WHEN seq%7=0 THEN dst_ip END AS host, CASE WHEN seq%5=0 THEN ['c2_beaconing','encrypted_malware'] ELSE ['volumetric_ddos'] END AS ks FROM fe WHERE seq%5=0 OR seq%7=0), u AS (SELECT host, unnest(ks) AS k FROM l) SELECT host, string_agg(DISTINCT k, ',' ORDER BY k) AS classes FROM u GROUP BY host",
    "iforest_score": f"WITH {FE} SELECT seq, round(pow(2,-((CASE WHEN bytes_out<9000 THEN CASE WHEN bytes_in<40000 THEN 2+{_C(120)} ELSE 2+{_C(80)} END ELSE 1+{_C(56)} END + CASE WHEN bytes_in<70000 THEN 1+{_C(180)} WHEN bytes_out<3000 THEN 2+{_C(30)} ELSE 2+{_C(46)} END)/2)/{_C(256)}),6) AS score FROM fe",
}
