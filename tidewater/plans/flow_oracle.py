"""DuckDB SQL for the queries over flows."""

from __future__ import annotations

from ..functions.features import MARKED_PORTS, SERVICE_DOMAINS
from ..schema import CAVEATS, DETECTORS, THREATS

FE = """fe AS (
SELECT event_id AS seq, epoch_us(ts) AS us, epoch_us(ts)/1e6::DOUBLE AS ts,
 concat('10.42.',CAST(user_id//250 AS VARCHAR),'.',CAST(user_id%250+2 AS VARCHAR)) AS src_ip,
 CASE event_type WHEN 'view' THEN concat('104.18.32.',CAST(k%8 AS VARCHAR)) WHEN 'click' THEN concat('10.42.0.',CAST(k%4+50 AS VARCHAR))
  WHEN 'purchase' THEN concat('203.0.113.',CAST(k%16 AS VARCHAR)) WHEN 'error' THEN concat('10.42.5.',CAST(k%10 AS VARCHAR)) ELSE '10.42.0.53' END AS dst_ip,
 CAST(1024+user_id%60000 AS INT) AS src_port,
 CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 9100 WHEN 'purchase' THEN 443 WHEN 'error' THEN CAST((k*7+user_id)%1024+1 AS INT) ELSE 53 END AS dst_port,
 CASE WHEN event_type='signup' THEN 'udp' ELSE 'tcp' END AS proto, k/10::DOUBLE AS duration, k+1 AS pkts_out, k%7 AS pkts_in,
 CAST(floor(value*100) AS BIGINT) AS bytes_out, CAST(k*1000+60 AS BIGINT) AS bytes_in,
 CASE WHEN event_type='signup' THEN 0 ELSE 1 END AS syn, CASE WHEN event_type IN ('signup','error') THEN 0 ELSE 1 END AS synack,
 CASE WHEN event_type='error' AND k%3=0 THEN 1 ELSE 0 END AS rst, 0 AS fin, k,
 CASE WHEN event_type IN ('view','purchase') THEN concat('t13d',CAST((user_id*3+k)%37 AS VARCHAR)) END AS tls_ja4,
 CASE WHEN event_type='view' AND k%3>0 THEN concat('site',CAST(k%8 AS VARCHAR),'.example.com') WHEN event_type='purchase' AND k%2=0 THEN 'clients.google.com' END AS tls_sni,
 event_type='purchase' AND k%5=0 AS tls_self_signed, CASE WHEN event_type='purchase' THEN k%90 END AS tls_cert_days
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events) e0)"""
FI = """fi AS (
SELECT event_id AS seq, epoch_us(ts)/1e6::DOUBLE AS ts, concat('10.43.0.',CAST(user_id%40 AS VARCHAR)) AS src_ip, concat('10.60.0.',CAST(k%6 AS VARCHAR)) AS dst_ip,
 k%9+1 AS ics_func, event_type='error' AS ics_write, k=99 AS ics_illegal
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events) e0 WHERE event_type IN ('click','error','view'))"""
FL = """fl AS (
SELECT epoch_us(l_shipdate)/1e6::DOUBLE AS ts, CAST(l_orderkey*10+l_linenumber AS BIGINT) AS seq,
 concat('10.50.',CAST(l_suppkey//250 AS VARCHAR),'.',CAST(l_suppkey%250+2 AS VARCHAR)) AS src_ip,
 CASE WHEN o_custkey%3=0 THEN concat('10.60.0.',CAST(o_custkey%200+2 AS VARCHAR)) ELSE concat('198.51.100.',CAST(o_custkey%200+2 AS VARCHAR)) END AS dst_ip,
 CAST(floor(l_extendedprice*CASE WHEN l_returnflag='R' THEN 20 ELSE 1 END) AS BIGINT) AS bytes_out, CAST(floor(l_quantity*1000) AS BIGINT) AS bytes_in
FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""
FQ = """fq AS (
SELECT page_id AS seq, concat('10.42.1.',CAST(page_id%5+2 AS VARCHAR)) AS src_ip, '10.42.0.53' AS dst_ip, regexp_extract(url,'^https?://([^/?#]+)',1) AS dns_qname,
 CASE page_id%7 WHEN 0 THEN 'TXT' WHEN 1 THEN 'CNAME' ELSE 'A' END AS dns_qtype, CASE WHEN page_id%4=0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS dns_rcode, page_id%100 AS bytes_out, page_id%37 AS bytes_in
FROM pages)"""


def windowed(view: str, seconds: float, out: str = "w") -> str:
    return f"{out} AS (SELECT *, o + (floor((ts-o)/{seconds}::DOUBLE)+1)*{seconds}::DOUBLE AS window_end FROM {view}, (SELECT min(ts) AS o FROM {view}) z)"


DAILY = f"{FE}, {windowed('fe', 86400)}"
PRIVATE = "({0} LIKE '10.%' OR {0} LIKE '192.168.%' OR regexp_matches({0}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
RECON = f"""{DAILY}, rc0 AS (
SELECT window_end, src_ip, count(DISTINCT (dst_ip, dst_port)) AS targets, count(DISTINCT dst_ip) AS hosts, count(DISTINCT dst_port) AS ports, count(*) AS observed_flows,
 bool_or(synack>0 OR bytes_in>0) AS reverse_visible, avg(CASE WHEN synack<=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unanswered, min(ts) AS ts_event
FROM w WHERE proto='tcp' AND syn>0 GROUP BY ALL HAVING count(DISTINCT (dst_ip, dst_port)) >= 3), rc AS (
SELECT *, CASE WHEN unanswered >= 0.3 THEN least(least(targets/300::DOUBLE,1)*0.55::DOUBLE + unanswered*0.45::DOUBLE, 1) END AS score FROM rc0)"""
TLS = f"""{DAILY}, tl AS (SELECT * FROM w WHERE tls_ja4 IS NOT NULL), tj AS (
SELECT a.ja4, a.window_end, count(*) AS n FROM (SELECT DISTINCT tls_ja4 AS ja4, window_end FROM tl) a JOIN (SELECT tls_ja4 AS ja4, src_ip, min(window_end) AS f FROM tl GROUP BY ALL) b ON a.ja4=b.ja4 AND b.f<=a.window_end GROUP BY ALL), td AS (
SELECT a.dst_ip, a.window_end, count(*) AS n FROM (SELECT DISTINCT dst_ip, window_end FROM tl) a JOIN (SELECT dst_ip, src_ip, min(window_end) AS f FROM tl GROUP BY ALL) b ON a.dst_ip=b.dst_ip AND b.f<=a.window_end GROUP BY ALL), th AS (
SELECT a.window_end, count(*) AS hosts FROM (SELECT DISTINCT window_end FROM tl) a JOIN (SELECT src_ip, min(window_end) AS f FROM tl GROUP BY ALL) b ON b.f<=a.window_end GROUP BY ALL), tp AS (
SELECT window_end, src_ip, dst_ip, max_by(tls_ja4, ts) AS ja4, bool_or(tls_self_signed) AS self_signed, min(CASE WHEN coalesce(tls_cert_days,0)=0 THEN 999 ELSE tls_cert_days END) AS min_days,
 bool_and(tls_sni IS NULL) AS no_sni, bool_or(tls_cert_days IS NOT NULL) AS cert_seen, 2/3::DOUBLE AS out_share, sum(k+40+k*10+1+k%5+1)/(3*count(*))::DOUBLE AS size_mean, count(*) AS observed_flows, min(ts) AS ts_event
FROM tl GROUP BY ALL), tx AS (
SELECT tp.*, tj.n AS ja4_hosts, td.n AS dst_hosts, th.hosts FROM tp JOIN tj ON tp.ja4=tj.ja4 AND tp.window_end=tj.window_end JOIN td ON tp.dst_ip=td.dst_ip AND tp.window_end=td.window_end JOIN th ON tp.window_end=th.window_end), tz AS (
SELECT *, CASE WHEN cert_seen THEN least((CASE WHEN hosts>=4 AND ja4_hosts<=1 THEN 35e-2 ELSE 0e0 END + CASE WHEN self_signed THEN 25e-2 ELSE 0e0 END + CASE WHEN min_days<=30 THEN 20e-2 ELSE 0e0 END + CASE WHEN no_sni THEN 10e-2 ELSE 0e0 END + 10e-2), 1)
 ELSE least((CASE WHEN hosts>=4 THEN CASE WHEN ja4_hosts<=1 THEN 30e-2 WHEN ja4_hosts<=3 THEN 15e-2 ELSE 0e0 END + CASE WHEN dst_hosts<=1 THEN 25e-2 WHEN dst_hosts<=3 THEN 12e-2 ELSE 0e0 END + CASE WHEN {PRIVATE.format('dst_ip')} THEN 0 ELSE 10e-2 END + CASE WHEN no_sni THEN 10e-2 ELSE 0e0 END ELSE 0e0 END
  + CASE WHEN hosts>=4 THEN 15e-2 ELSE 30e-2 END), 85e-2) END AS score FROM tx)"""
ICS = f"""{FI}, {windowed('fi', 432000, 'wi')}, ip0 AS (
SELECT window_end, src_ip, dst_ip, count(*) AS n, count(*) FILTER (NOT ics_write AND NOT ics_illegal) AS reads, count(*) FILTER (ics_write) AS writes, count(*) FILTER (ics_illegal) AS illegal, min(ts) AS first FROM wi GROUP BY ALL), ip AS (
SELECT *, coalesce(sum(reads) OVER (PARTITION BY src_ip, dst_ip ORDER BY window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 1 AS known FROM ip0), ifn AS (
SELECT window_end, src_ip, list_sort(list(DISTINCT ics_func)) AS funcs FROM wi GROUP BY ALL), ig AS (
SELECT window_end, src_ip, CAST(sum(n) AS BIGINT) AS observed_flows, count(*) AS controllers, CAST(sum(writes) AS BIGINT) AS writes, CAST(sum(CASE WHEN NOT known THEN writes ELSE 0 END) AS BIGINT) AS unauthorised, CAST(sum(illegal) AS BIGINT) AS illegal, min(first) AS ts_event,
 arg_max(dst_ip, n*1000000 + CAST(split_part(dst_ip,'.',4) AS INT)) AS dst_ip FROM ip GROUP BY ALL), iz AS (
SELECT ig.*, funcs, least((CASE WHEN len(funcs)>=3 THEN least(len(funcs)/7::DOUBLE,1)*0.62::DOUBLE ELSE 0 END) + CASE WHEN unauthorised>0 THEN 0.55::DOUBLE ELSE 0 END + CASE WHEN illegal>0 THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN controllers>=3 AND writes>0 THEN 0.15::DOUBLE ELSE 0 END, 1) AS score
FROM ig JOIN ifn ON ig.window_end=ifn.window_end AND ig.src_ip=ifn.src_ip)"""
GAPS = f"{FE}, g AS (SELECT * FROM (SELECT src_ip, ts, seq, ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, seq) AS gap FROM fe) z WHERE gap IS NOT NULL)"
LEX = f"{FQ}, lx AS (SELECT seq, dns_qname, string_split(dns_qname,'.')[1] AS first, regexp_replace(string_split(dns_qname,'.')[1],'[^\\p{{L}}\\p{{N}}]','','g') AS body, len(list_filter(string_split(dns_qname,'.'), lambda x: x<>'')) AS n_labels FROM fq), le AS (SELECT seq, entropy(ch) AS entropy FROM (SELECT seq, unnest(string_split(body,'')) AS ch FROM lx) z GROUP BY seq)"
PAIRS = f"{FQ}, nm AS (SELECT seq, concat('^',regexp_replace(lower(dns_qname),'[^\\p{{L}}\\p{{N}}]','','g'),'$') AS m, concat('^',lower(dns_qname),'$') AS raw FROM fq), pr AS (SELECT substr(m,i,2) AS pair, count(*) AS n FROM (SELECT m, unnest(range(1,len(m))) AS i FROM nm) z GROUP BY ALL), tb AS (SELECT pair, ln((n+1)/((SELECT sum(n) FROM pr)+1444)::DOUBLE) AS logp FROM pr UNION ALL SELECT '__default__', ln(1/((SELECT sum(n) FROM pr)+1444)::DOUBLE))"
_VECTOR = ["log10(bytes_out+1.0::DOUBLE)", "log10(bytes_in+1.0::DOUBLE)", "log10(bytes_out/greatest(bytes_in,1)::DOUBLE+0.01::DOUBLE)", "log10(duration+0.01::DOUBLE)", "log10(pkts_out+1.0::DOUBLE)", "log10(pkts_in+1.0::DOUBLE)", "syn", "synack", "rst", "fin", "CASE WHEN proto='udp' THEN 1 ELSE 0 END", "0", *[f"CASE WHEN dst_port={p} THEN 1 ELSE 0 END" for p in MARKED_PORTS]]
FLOOD = f"""{DAILY}, fd AS (
SELECT window_end, dst_ip, count(*) AS n, count(DISTINCT src_ip) AS sources, entropy(src_ip) AS entropy, count(*) FILTER (proto='udp') AS udp, CAST(0 AS BIGINT) AS reflections, min(ts) AS ts_event,
 CASE WHEN count(*) FILTER (proto='tcp') >= 0.5*count(*) THEN coalesce(sum(synack) FILTER (proto='tcp'),0)/greatest(coalesce(sum(syn) FILTER (proto='tcp'),0),1)::DOUBLE END AS completion
FROM w WHERE syn>0 OR proto='udp' GROUP BY ALL)"""
BEACON = f"""{FE}, {windowed('fe', 864000, 'wb')}, bh AS (SELECT * FROM wb WHERE proto='tcp' AND syn>0), bl AS (SELECT max(window_end) AS last FROM bh), bs AS (
SELECT bh.*, window_end + i*864000::DOUBLE AS wat FROM bh, bl, range(0,3) r(i) WHERE i <= floor((ts+2592000-window_end)/864000) AND i <= round((last-window_end)/864000)), bz AS (
SELECT *, count(*) OVER (PARTITION BY src_ip,dst_ip,wat) AS n_events, ts - lag(ts) OVER (PARTITION BY src_ip,dst_ip,wat ORDER BY ts, seq) AS gap FROM bs), ba AS (
SELECT src_ip, dst_ip, wat, count(*) AS n_events, avg(gap) AS m, stddev_samp(gap) AS sd, median(gap) AS med, mad(gap) AS mad, avg(bytes_out) AS bm, stddev_samp(bytes_out) AS bsd, max(ts) AS ts_event FROM bz WHERE n_events>=4 GROUP BY ALL), bp AS (
SELECT a.dst_ip, a.wat, count(*) AS dst_prevalence FROM (SELECT DISTINCT dst_ip, wat FROM ba) a JOIN (SELECT dst_ip, src_ip, min(window_end) AS f FROM bh GROUP BY ALL) b ON a.dst_ip=b.dst_ip AND b.f<=a.wat GROUP BY ALL), bc AS (
SELECT ba.*, dst_prevalence, CASE WHEN m>0 THEN coalesce(sd,0)/m ELSE 0 END AS cv, mad/CASE WHEN med=0 THEN 1 ELSE med END AS mr, CASE WHEN bm>0 THEN coalesce(bsd,0)/bm ELSE 0 END AS bcv FROM ba JOIN bp ON ba.dst_ip=bp.dst_ip AND ba.wat=bp.wat)"""
EXFIL = f"""{FL}, {windowed('fl', 2592000, 'wx')}, xd AS (
SELECT window_end, src_ip, dst_ip, CAST(sum(bytes_out) AS BIGINT) AS up, CAST(sum(bytes_in) AS BIGINT) AS down, count(*) AS n, min((ts, seq)) AS first, min(ts) AS t0 FROM wx GROUP BY ALL), xn AS (
SELECT *, min(window_end) OVER (PARTITION BY src_ip, dst_ip)=window_end AS novel, row_number() OVER (PARTITION BY window_end, src_ip ORDER BY up DESC, first, dst_ip DESC) AS rk FROM xd), xs AS (
SELECT window_end, src_ip, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down, CAST(sum(n) AS BIGINT) AS n, sum(up)/greatest(sum(down),1)::DOUBLE AS ratio, max(dst_ip) FILTER (rk=1) AS dst_ip, max(up) FILTER (rk=1) AS top_up, bool_or(novel) FILTER (rk=1) AS novel, min(t0) AS ts_event FROM xn GROUP BY ALL), xr AS (
SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY window_end) AS rn FROM xs), xe AS (
SELECT src_ip, rn, NULL::DOUBLE AS base, ratio AS after FROM xr WHERE rn=1 UNION ALL SELECT xr.src_ip, xr.rn, xe.after, (1-0.25::DOUBLE)*xe.after + 0.25::DOUBLE*xr.ratio FROM xe JOIN xr ON xr.src_ip=xe.src_ip AND xr.rn=xe.rn+1), xf AS (
SELECT xr.*, base, least(ratio,50) AS oir, least(ratio/greatest(base,0.2::DOUBLE),30) AS dev, {PRIVATE.format('dst_ip')} AS pv FROM xr JOIN xe ON xr.src_ip=xe.src_ip AND xr.rn=xe.rn WHERE base IS NOT NULL AND up>=200000)"""
EWMA = """fr AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY window_end) AS rn FROM fd), ft AS (
SELECT dst_ip, rn, 0.0::DOUBLE AS base, NULL::DOUBLE AS score, 0.0::DOUBLE AS after FROM (SELECT DISTINCT dst_ip, 0 AS rn FROM fr) z
UNION ALL SELECT dst_ip, rn, base, score, CASE WHEN score>=0.35::DOUBLE THEN base ELSE 0.8::DOUBLE*base+(1-0.8::DOUBLE)*n END FROM (
SELECT fr.dst_ip, fr.rn, fr.n, ft.after AS base, CASE WHEN fr.n>=12 THEN least(CASE WHEN entropy>=3 THEN least((entropy-3)/4,1)*0.45::DOUBLE ELSE 0 END
 + CASE WHEN completion IS NULL THEN least(greatest(fr.n/greatest(ft.after,1)-5,0)/10,1)*0.35::DOUBLE WHEN completion<=0.9::DOUBLE THEN (1-completion/0.9::DOUBLE)*0.35::DOUBLE ELSE 0 END
 + CASE WHEN fr.n/greatest(ft.after,1)>3 THEN least((fr.n/greatest(ft.after,1)-3)/10,1)*0.20::DOUBLE ELSE 0 END, 1) END AS score FROM ft JOIN fr ON fr.dst_ip=ft.dst_ip AND fr.rn=ft.rn+1) q)"""
BEACON_SCORE = "least(CASE WHEN cv<0.45 THEN (1-cv/0.45::DOUBLE)*0.5::DOUBLE ELSE 0 END+CASE WHEN mr<0.35 THEN (1-mr/0.35::DOUBLE)*0.25::DOUBLE ELSE 0 END+CASE WHEN bcv<0.25 THEN (1-bcv/0.25::DOUBLE)*0.25::DOUBLE ELSE 0 END,1)*CASE WHEN dst_prevalence>=3 THEN 0.25::DOUBLE ELSE 1 END"
EXFIL_SCORE = "least(CASE WHEN oir>3 THEN least(oir/20,1)*0.40::DOUBLE ELSE 0 END+CASE WHEN dev>3 THEN least((dev-3)/8,1)*0.30::DOUBLE ELSE 0 END+CASE WHEN novel THEN 0.20::DOUBLE ELSE 0 END+CASE WHEN up>5000000 THEN 0.10::DOUBLE ELSE 0 END,0.82::DOUBLE)"
DGA = """ns AS (SELECT fq.*, (CASE WHEN entropy>3.2 THEN 0.4 ELSE 0 END + CASE WHEN len(regexp_replace(body,'[^aeiou]','','g'))/greatest(len(body),1)::DOUBLE<0.30::DOUBLE THEN 0.3 ELSE 0 END + CASE WHEN coalesce(list_max(list_transform(regexp_extract_all(body,'[b-df-hj-np-tv-zA-Z]+'), lambda x: len(x))),0)>=4 THEN 0.3 ELSE 0 END)::DOUBLE AS sc FROM fq JOIN lx ON fq.seq=lx.seq JOIN le ON fq.seq=le.seq WHERE fq.dns_qname<>''), h AS (
SELECT src_ip, min(dst_ip) AS dst_ip, min(seq)::DOUBLE AS ts_event, count(*) AS observed_flows, avg(CASE WHEN sc>0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS suspicious, avg(CASE WHEN dns_rcode='NXDOMAIN' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS nx, avg(sc) AS mean_score, array_to_string(list_slice(list(dns_qname ORDER BY sc DESC, seq),1,3),',') AS examples FROM ns GROUP BY src_ip HAVING count(*)>=8)"""
DGA_SCORE = "least(0.55::DOUBLE*suspicious+0.45::DOUBLE*least(nx*1.6::DOUBLE,1),1)"
TUNNEL = """l AS (SELECT *, regexp_extract(dns_qname,'([^.]+\\.[^.]+)$',1) AS parent FROM fq WHERE dns_qname<>''), a AS (
SELECT src_ip, parent, min(seq)::DOUBLE AS ts_event, count(*) AS observed_flows, count(DISTINCT dns_qname) AS unique_names, CAST(sum(bytes_out) AS BIGINT) AS bytes_up, CAST(sum(bytes_in) AS BIGINT) AS bytes_down, avg(CASE WHEN len(dns_qname)>=20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS lr, avg(CASE WHEN dns_qtype IN ('TXT','NULL','CNAME') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS tr, count(DISTINCT dns_qname)/count(*)::DOUBLE AS ur, avg(len(dns_qname)) AS ml FROM l GROUP BY ALL HAVING count(*)>=3)"""
TUNNEL_SCORE = "least(0.40::DOUBLE*lr+0.25::DOUBLE*tr+0.20::DOUBLE*ur+CASE WHEN observed_flows>10 THEN 0.15::DOUBLE ELSE 0 END,1)"
DETECTIONS = f"""{RECON}, {TLS.replace(DAILY + ', ', '')}, {ICS}, {FLOOD.replace(DAILY + ', ', '')}, {EWMA}, {BEACON.replace(FE + ', ', '')}, {LEX}, {DGA}, {TUNNEL}, {EXFIL}, det AS (
SELECT window_end, 'recon_scanning' AS threat_class, src_ip, concat(CAST(hosts AS VARCHAR),' hosts') AS dst_ip, score, ts_event, reverse_visible, CASE WHEN NOT reverse_visible THEN '{CAVEATS['one_way_scan']}' END AS caveat FROM rc WHERE score>=0.2
UNION ALL SELECT window_end, 'encrypted_malware', src_ip, dst_ip, score, ts_event, true, CASE WHEN cert_seen THEN '{CAVEATS['metadata']}' ELSE '{CAVEATS['client_side']}' END FROM tz WHERE score>=0.55
UNION ALL SELECT window_end, 'ics_intrusion', src_ip, dst_ip, score, ts_event, true, '{CAVEATS['commands']}' FROM iz WHERE score>=0.55
UNION ALL SELECT fr.window_end, 'volumetric_ddos', concat(CAST(sources AS VARCHAR),' sources'), fr.dst_ip, score, ts_event, true, NULL FROM ft JOIN fr ON ft.dst_ip=fr.dst_ip AND ft.rn=fr.rn WHERE score>=0.35::DOUBLE
UNION ALL SELECT wat, 'c2_beaconing', src_ip, dst_ip, {BEACON_SCORE}, ts_event, true, NULL FROM bc WHERE {BEACON_SCORE}>=0.05::DOUBLE
UNION ALL SELECT (SELECT min(seq) FROM fq)+1000000::DOUBLE, 'dga_resolution', src_ip, dst_ip, {DGA_SCORE}, ts_event, true, NULL FROM h WHERE {DGA_SCORE}>=0.3::DOUBLE
UNION ALL SELECT (SELECT min(seq) FROM fq)+1000000::DOUBLE, 'dns_tunnelling', src_ip, parent, {TUNNEL_SCORE}, ts_event, true, NULL FROM a WHERE {TUNNEL_SCORE}>=0.3::DOUBLE
UNION ALL SELECT window_end, 'data_exfiltration', src_ip, dst_ip, {EXFIL_SCORE}, ts_event, true, '{CAVEATS['lead']}' FROM xf WHERE {EXFIL_SCORE}>=0.3::DOUBLE), dn AS (
SELECT *, row_number() OVER (PARTITION BY threat_class, src_ip, dst_ip ORDER BY window_end) AS rn FROM det), dd AS (
SELECT *, window_end AS last, true AS emit FROM dn WHERE rn=1
UNION ALL SELECT dn.*, CASE WHEN dn.window_end-dd.last>=172800 THEN dn.window_end ELSE dd.last END, dn.window_end-dd.last>=172800 FROM dd JOIN dn ON dn.threat_class=dd.threat_class AND dn.src_ip=dd.src_ip AND dn.dst_ip=dd.dst_ip AND dn.rn=dd.rn+1)"""
_OF = {k: rest for k, *rest in DETECTORS}
_THREATS = ", ".join(f"('{a}','{b}','{t}','{k}','{_OF[a][0]}','{_OF[a][1]}')" for a, b, t, _, k in THREATS)
ALERTS = f"""{DETECTIONS}, th0(threat_class, base, technique, tactic, detector, model_version) AS (VALUES {_THREATS}), al0 AS (
SELECT dd.*, base, technique, tactic, detector, model_version, round_even(greatest(least(score,1),0),3) AS raw FROM dd JOIN th0 ON dd.threat_class=th0.threat_class WHERE emit), al1 AS (
SELECT *, CASE threat_class WHEN 'encrypted_malware' THEN CASE WHEN raw>=0.75 THEN 0.92 WHEN raw>=0.65 THEN 0.7 ELSE 0.6 END WHEN 'ics_intrusion' THEN CASE WHEN raw>=0.8 THEN 0.95 ELSE 0.55 END ELSE raw END::DOUBLE AS confidence FROM al0), al AS (
SELECT *, CASE WHEN confidence<0.6::DOUBLE AND base IN ('critical','high') THEN 'medium' WHEN confidence>0.9::DOUBLE AND base='medium' THEN 'high' ELSE base END AS severity FROM al1)"""
INCIDENTS = f"""{ALERTS}, an AS (
SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY window_end, alert_id) AS r FROM (SELECT *, 'prh-'||substr(sha256(concat(threat_class,'|',src_ip,'|',dst_ip,'|',printf('%.1f',window_end))),1,12) AS alert_id FROM al) z), inc AS (
SELECT src_ip, r, ts_event AS seen, 1 AS part FROM an WHERE r=1
UNION ALL SELECT an.src_ip, an.r, CASE WHEN an.ts_event-inc.seen>518400 THEN an.ts_event ELSE greatest(inc.seen, an.ts_event) END, inc.part + CASE WHEN an.ts_event-inc.seen>518400 THEN 1 ELSE 0 END FROM inc JOIN an ON an.src_ip=inc.src_ip AND an.r=inc.r+1), fin AS (
SELECT an.src_ip AS entity, inc.part, min(ts_event) AS first_seen, max(seen) AS last_seen, count(*) AS n_alerts, count(DISTINCT threat_class) AS n_classes, max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS sv, max(confidence) AS best
FROM an JOIN inc ON an.src_ip=inc.src_ip AND an.r=inc.r GROUP BY ALL), ii AS (
SELECT *, round_even(least(best + 0.05::DOUBLE*(n_classes-1),1),3) AS score FROM fin QUALIFY part = max(part) OVER (PARTITION BY entity))"""
LEDGER = f"""{FE}, lb AS (SELECT row_number() OVER (ORDER BY seq) AS seq, concat_ws('/',src_ip,dst_ip,CAST(bytes_out AS VARCHAR)) AS body FROM fe), lg AS (
SELECT seq, body, repeat('0',64) AS prev_sha256, sha256(concat(repeat('0',64),'|',CAST(seq AS VARCHAR),'|',body)) AS sha256 FROM lb WHERE seq=1
UNION ALL SELECT lb.seq, lb.body, lg.sha256, sha256(concat(lg.sha256,'|',CAST(lb.seq AS VARCHAR),'|',lb.body)) FROM lg JOIN lb ON lb.seq=lg.seq+1)"""
_SERVICE = ", ".join(f"('{d}')" for d in SERVICE_DOMAINS)
Z = "((bytes_out-9000::DOUBLE)/5000)*0.8::DOUBLE", "((bytes_in-50000::DOUBLE)/30000)*-0.5::DOUBLE", "((duration-5::DOUBLE)/3)*1.1::DOUBLE"

ORACLE = {
    "recon_fanout": f"WITH {RECON} SELECT round(window_end,6) AS window_end, round(unanswered,6) AS unanswered, round(score,6) AS score, round(ts_event,6) AS ts_event, src_ip, targets, hosts, ports, observed_flows, reverse_visible FROM rc",
    "recon_detections": f"WITH {RECON} SELECT round(window_end,6) AS window_end, round(score,6) AS score, round(ts_event,6) AS ts_event, 'recon_scanning' AS threat_class, src_ip, concat(CAST(hosts AS VARCHAR),' hosts') AS dst_ip, observed_flows FROM rc WHERE score>=0.2",
    "flow_ids": f"WITH {FE}, m AS (SELECT *, (us+500)//1000 AS ms FROM fe) SELECT seq, 'f-'||substr(sha256(concat(CAST(ms//1000 AS VARCHAR),'.',lpad(CAST(ms%1000 AS VARCHAR),3,'0'),'|',src_ip,':',src_port,'|',dst_ip,':',dst_port,'|',proto)),1,10) AS flow_id, synack>0 AS completed, round(bytes_out/greatest(bytes_in,1)::DOUBLE,6) AS byte_ratio FROM m",
    "alert_ids": f"WITH {RECON} SELECT src_ip, concat(CAST(hosts AS VARCHAR),' hosts') AS dst_ip, 'prh-'||substr(sha256(concat('recon_scanning|',src_ip,'|',hosts,' hosts|',printf('%.1f',window_end))),1,12) AS alert_id FROM rc WHERE score>=0.2",
    "oneway_projection": f"WITH {FE} SELECT seq, CAST(pkts_out AS BIGINT) AS pkts_out, CAST(0 AS BIGINT) AS pkts_in, bytes_out, CAST(0 AS BIGINT) AS bytes_in, 0 AS synack, 0 AS rst, false AS tls_self_signed, CAST(NULL AS INT) AS tls_cert_days, 2 AS sizes FROM fe",
    "rfc1918_split": f"WITH {FE} SELECT {PRIVATE.format('src_ip')} AS src_private, {PRIVATE.format('dst_ip')} AS dst_private, count(*) AS n FROM fe GROUP BY ALL",
    "sni_allowlist": f"WITH {FE}, sd(d) AS (VALUES {_SERVICE}) SELECT tls_sni, count(*) AS n, EXISTS (SELECT 1 FROM sd WHERE tls_sni=d OR ends_with(tls_sni,'.'||d)) AS service FROM fe WHERE tls_sni IS NOT NULL GROUP BY tls_sni",
    "windows_anchored": f"WITH {DAILY} SELECT round(window_end,6) AS window_end, count(*) AS n, min(seq) AS first_seq FROM w GROUP BY ALL",
    "windows_realigned": f"WITH RECURSIVE {FE}, p AS (SELECT ts, lag(ts) OVER (ORDER BY ts, seq) AS prev FROM fe), gg AS (SELECT ts, prev, row_number() OVER (ORDER BY ts) AS rn FROM p WHERE prev IS NULL OR ts-prev>300), rr AS (SELECT rn, ts, ts AS origin FROM gg WHERE rn=1 UNION ALL SELECT gg.rn, gg.ts, CASE WHEN gg.ts-(origin+(floor((gg.prev-origin)/30::DOUBLE)+1)*30::DOUBLE)>300 THEN gg.ts ELSE origin END FROM rr JOIN gg ON gg.rn=rr.rn+1), j AS (SELECT fe.*, rr.origin FROM fe ASOF JOIN rr ON fe.ts>=rr.ts) SELECT round(origin+(floor((ts-origin)/30::DOUBLE)+1)*30::DOUBLE,6) AS window_end, count(*) AS n, min(seq) AS first_seq FROM j GROUP BY 1",
    "src_entropy": f"WITH {DAILY} SELECT round(window_end,6) AS window_end, round(entropy(src_ip),6) AS entropy, round(CASE WHEN count(DISTINCT src_ip)<=1 THEN 0 ELSE entropy(src_ip)/log2(count(DISTINCT src_ip)) END,6) AS normalised, count(*) AS n, count(DISTINCT src_ip) AS \"distinct\" FROM w GROUP BY ALL",
    "interval_stats": f"WITH {GAPS}, a AS (SELECT src_ip, count(*) AS n, avg(gap) AS mean, coalesce(stddev_samp(gap),0) AS sd, median(gap) AS median, mad(gap) AS mad FROM g GROUP BY ALL), b AS (SELECT *, CASE WHEN mean>0 THEN sd/mean ELSE 0 END AS cv FROM a) SELECT src_ip, n, round(mean,4) AS mean, round(sd,4) AS sd, round(median,4) AS median, round(mad,4) AS mad, round(cv,4) AS cv, round(1/(1+cv),4) AS regularity, round(exp(-pow((cv-0.16::DOUBLE)/0.13::DOUBLE,2)),4) AS jitter_band FROM b",
    "autocorr": f"WITH {GAPS}, x AS (SELECT src_ip, gap, row_number() OVER (PARTITION BY src_ip ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY src_ip) AS n, avg(gap) OVER (PARTITION BY src_ip) AS m FROM g), e AS (SELECT src_ip, max(n) AS n, sum((gap-m)*(gap-m)) AS en FROM x GROUP BY ALL), l AS (SELECT a.src_ip, b.i-a.i AS lag, sum((a.gap-a.m)*(b.gap-b.m)) AS s FROM x a JOIN x b ON a.src_ip=b.src_ip AND b.i>a.i AND b.i-a.i<=a.n//2 GROUP BY ALL) SELECT e.src_ip, round(CASE WHEN e.n<4 THEN 0 ELSE CASE WHEN en=0 THEN 1 ELSE greatest(max(s)/en,0) END END,5) AS peak FROM e LEFT JOIN l ON e.src_ip=l.src_ip GROUP BY e.src_ip, e.n, en",
    "domain_parts": f"WITH {FQ}, l AS (SELECT *, list_filter(string_split(dns_qname,'.'), lambda x: x<>'') AS p FROM fq) SELECT seq, dns_qname, CAST(len(p) AS INT) AS n_labels, CASE WHEN len(p)>=2 THEN concat(p[len(p)-1],'.',p[len(p)]) ELSE dns_qname END AS parent FROM l",
    "lexical": f"WITH {LEX} SELECT lx.seq, len(first)::DOUBLE AS length, round(entropy,6) AS entropy, round(len(regexp_replace(body,'[^aeiou]','','g'))/greatest(len(body),1)::DOUBLE,6) AS vowel_ratio, round(len(regexp_replace(body,'[^0-9]','','g'))/greatest(len(body),1)::DOUBLE,6) AS digit_ratio, coalesce(list_max(list_transform(regexp_extract_all(body,'[b-df-hj-np-tv-zA-Z]+'), lambda x: len(x))),0)::DOUBLE AS consonant_run, n_labels::DOUBLE AS n_labels FROM lx JOIN le ON lx.seq=le.seq",
    "bigram_fit": f"WITH {PAIRS} SELECT pair, round(logp,6) AS logp FROM tb",
    "bigram_ll": f"WITH {PAIRS}, z AS (SELECT seq, substr(raw,i,2) AS pair FROM (SELECT seq, raw, unnest(range(1,len(raw))) AS i FROM nm) y) SELECT seq, round(avg(coalesce(logp,(SELECT logp FROM tb WHERE pair='__default__'))),6) AS bigram_ll FROM z LEFT JOIN tb ON z.pair=tb.pair GROUP BY seq",
    "shape_features": "WITH z AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE)*1000) AS INT))) AS v FROM embeddings) SELECT vec_id, round(avg(CASE WHEN v>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS out_share, round(avg(abs(v)),6) AS size_mean, round(stddev_samp(abs(v)),6) AS size_sd FROM z GROUP BY vec_id",
    "anomaly_vector": f"WITH {FE} SELECT seq, " + ", ".join(f"round(({v})::DOUBLE,6) AS v{i}" for i, v in enumerate(_VECTOR)) + " FROM fe",
    "nearest_rank_pct": f"WITH {FE}, s AS (SELECT bytes_out, row_number() OVER (ORDER BY bytes_out)-1 AS i, count(*) OVER () AS n FROM fe) SELECT p::DOUBLE AS p, bytes_out FROM s, (VALUES (0.5),(0.95),(0.99)) v(p) WHERE i=least(CAST(round_even(p::DOUBLE*(n-1),0) AS BIGINT),n-1)",
    "floor_pct_envelope": f"WITH {FE}, s AS (SELECT bytes_out, row_number() OVER (ORDER BY bytes_out)-1 AS i, count(*) OVER () AS n FROM fe) SELECT p::DOUBLE AS p, bytes_out FROM s, (VALUES (0.001),(0.01),(0.99),(0.999)) v(p) WHERE i=least(CAST(floor(n*p::DOUBLE) AS BIGINT),n-1)",
    "ddos_windows": f"WITH {FLOOD} SELECT round(window_end,6) AS window_end, round(entropy,6) AS entropy, round(completion,6) AS completion, round(ts_event,6) AS ts_event, dst_ip, n, sources, udp, reflections FROM fd",
    "ddos_ewma_freeze": f"""WITH RECURSIVE {FLOOD}, {EWMA}
SELECT round(fr.window_end,6) AS window_end, round(ft.base,6) AS base, round(ft.score,6) AS score, fr.dst_ip, fr.n FROM ft JOIN fr ON ft.dst_ip=fr.dst_ip AND ft.rn=fr.rn""",
    "beacon_pairs": f"WITH {BEACON} SELECT src_ip, dst_ip, round(wat,3) AS window_end, n_events, dst_prevalence, round(cv,4) AS interval_cv, round(mr,4) AS mad_ratio, round(bcv,4) AS byte_cv, round(1/(1+greatest(cv,0)),4) AS regularity, round(exp(-pow((cv-0.16::DOUBLE)/0.13::DOUBLE,2)),4) AS jitter_band, CASE WHEN {PRIVATE.format('dst_ip')} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS dst_external, round({BEACON_SCORE},4) AS score FROM bc",
    "dga_hosts": f"""WITH {LEX}, {DGA}
SELECT src_ip, dst_ip, observed_flows, round(suspicious,6) AS suspicious, round(nx,6) AS nx, round(mean_score,6) AS mean_score, round({DGA_SCORE},6) AS score, examples FROM h""",
    "tunnel_parents": f"""WITH {FQ}, {TUNNEL}
SELECT src_ip, parent, observed_flows, unique_names, bytes_up, bytes_down, round(lr,6) AS long_rate, round(tr,6) AS type_rate, round(ur,6) AS unique_rate, round(ml,6) AS mean_length, round({TUNNEL_SCORE},6) AS score FROM a""",
    "tls_pairs": f"WITH {TLS} SELECT round(window_end,6) AS window_end, round(out_share,6) AS out_share, round(size_mean,6) AS size_mean, round(score,6) AS score, src_ip, dst_ip, ja4, ja4_hosts, dst_hosts, hosts, self_signed, min_days, no_sni, cert_seen, observed_flows FROM tz",
    "exfil_windows": f"WITH RECURSIVE {EXFIL} SELECT src_ip, dst_ip, up AS bytes_up, down AS bytes_down, n AS observed_flows, round(window_end,3) AS window_end, ratio, base, round(dev,5) AS deviation, top_up/greatest(up,1)::DOUBLE AS dst_concentration, CASE WHEN novel THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dst_novelty, CASE WHEN pv THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS dst_external, up/greatest(up+down,1)::DOUBLE AS out_share, round({EXFIL_SCORE},5) AS score FROM xf",
    "ics_writes": f"WITH {ICS} SELECT round(window_end,6) AS window_end, round(score,6) AS score, src_ip, dst_ip, observed_flows, array_to_string(funcs,',') AS funcs, controllers, writes, unauthorised, illegal FROM iz",
    "dedupe": f"WITH RECURSIVE {DETECTIONS} SELECT threat_class, src_ip, dst_ip, round(window_end,3) AS window_end, round(score,4) AS score FROM dd WHERE emit",
    "suppress": f"WITH RECURSIVE {DETECTIONS} SELECT threat_class, count(*) AS n, count(DISTINCT src_ip) AS sources FROM det WHERE src_ip NOT IN ('10.42.0.2','203.0.113.3','10.60.0.1') AND dst_ip NOT IN ('10.42.0.2','203.0.113.3','10.60.0.1') GROUP BY ALL",
    "alerts": f"WITH RECURSIVE {ALERTS} SELECT threat_class, src_ip, dst_ip, severity, round(confidence,3) AS confidence, round(raw,3) AS raw_score, round(window_end,3) AS ts_emitted, technique, tactic, detector, model_version, reverse_visible AS reverse_direction_visible, caveat FROM al",
    "alert_flow_ids": f"WITH RECURSIVE {ALERTS}, ids AS (SELECT *, 'f-'||substr(sha256(concat(CAST(ms//1000 AS VARCHAR),'.',lpad(CAST(ms%1000 AS VARCHAR),3,'0'),'|',src_ip,':',src_port,'|',dst_ip,':',dst_port,'|',proto)),1,10) AS flow_id FROM (SELECT *, (us+500)//1000 AS ms FROM w) z), lo AS (SELECT al.threat_class, al.src_ip, al.dst_ip, al.window_end, list(flow_id ORDER BY ids.ts, ids.seq)[1:8] AS fl FROM al JOIN ids ON al.window_end=ids.window_end AND al.src_ip=ids.src_ip AND CASE al.threat_class WHEN 'recon_scanning' THEN ids.proto='tcp' AND ids.syn>0 ELSE ids.tls_ja4 IS NOT NULL AND ids.dst_ip=al.dst_ip END WHERE al.threat_class IN ('recon_scanning','encrypted_malware') GROUP BY ALL) SELECT 'prh-'||substr(sha256(concat(threat_class,'|',src_ip,'|',dst_ip,'|',printf('%.1f',window_end))),1,12) AS alert_id, array_to_string(fl,',') AS flow_ids FROM lo",
    "incidents": f"WITH RECURSIVE {INCIDENTS} SELECT entity, round(first_seen,3) AS first_seen, round(last_seen,3) AS last_seen, CAST(n_alerts AS INT) AS n_alerts, CAST(n_classes AS INT) AS n_classes, CASE sv WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity, score FROM ii",
    "ranked_incidents": f"WITH RECURSIVE {INCIDENTS} SELECT entity, CAST(n_classes AS INT) AS n_classes, score FROM ii WHERE n_classes>1 ORDER BY score DESC, n_classes DESC, entity LIMIT 10",
    "ledger_chain": f"WITH RECURSIVE {LEDGER} SELECT * FROM lg",
    "ledger_verify": f"WITH RECURSIVE {LEDGER} SELECT kind='whole' AS ok, (SELECT count(*) FROM lg) AS n, CASE WHEN kind='edited' THEN CAST(123 AS BIGINT) END AS first_bad, kind FROM (VALUES ('whole'),('edited')) v(kind)",
    "lr_score": f"WITH {FE} SELECT seq, round(1/(1+exp(-(-0.2::DOUBLE+{'+'.join(Z)}))),6) AS p FROM fe",
    "lr_explain": f"WITH {FE}, t AS (SELECT seq, unnest([{{'i':0,'f':'bytes_out','c':{Z[0]},'v':bytes_out::DOUBLE}},{{'i':1,'f':'bytes_in','c':{Z[1]},'v':bytes_in::DOUBLE}},{{'i':2,'f':'duration','c':{Z[2]},'v':duration}}]) AS e FROM fe), r AS (SELECT seq, e, row_number() OVER (PARTITION BY seq ORDER BY abs(e.c) DESC, e.i) AS rk FROM t) SELECT seq, e.f AS feature, round(e.c,3) AS contribution, round(e.v,4) AS value FROM r WHERE rk<=2 AND abs(e.c)>1e-6",
}
