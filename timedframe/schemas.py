"""Declared schemas of the files the library reads and writes."""

WORD = "struct<word:string,start:double,end:double>"
SEGMENT = f"struct<id:int,start:double,end:double,text:string,text_original:string,speaker:string,residual_risk:double,words:array<{WORD}>>"
TRANSCRIPT = f"media_id string, part int, language string, duration_s double, segments array<{SEGMENT}>"
UTTERANCES = "struct<results:struct<utterances:array<struct<transcript:string,start:double,end:double>>>,metadata:struct<duration:double>>"
EVENT = "ts double, service string, event string, job_id string, payload string, date date"
