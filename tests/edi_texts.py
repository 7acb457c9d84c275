"""Small EDI inputs, one per rule."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

AS_OF = "2024-01-01"


def isa(e="*", c=":", t="~", sender="SENDER", control="000000001"):
    return e.join(["ISA", "00", " " * 10, "00", " " * 10, "ZZ", f"{sender:<15}", "ZZ",
                   f"{'RECEIVER':<15}", "230101", "1200", "^", "00501", control, "0", "P", c]) + t


def text(kind, *segments, e="*", c=":", t="~", head=None):
    body = [f"GS{e}X", f"ST{e}{kind}{e}1", *segments, f"SE{e}1", f"IEA{e}1"]
    return (isa(e, c, t) if head is None else head) + t.join(
        s.replace("*", e).replace(":", c) for s in body) + t


# The two sample interchanges whose results are known.
SAMPLE_837 = isa() + "~".join([
    "GS*HC*SENDER*RECEIVER*20230101*1200*1*X*005010X222A1", "ST*837*0001*005010X222A1",
    "BHT*0019*00*BATCH001*20230101*1200*CH",
    "NM1*41*2*BILLING PROVIDER*****46*123456789", "N1*PR*TEST PAYER",
    "NM1*IL*1*DOE*JOHN****MI*PATIENT001", "CLM*CLM-001*1500***11:B:1*Y*A*Y*Y",
    "DTP*472*D8*20230115", "HI*ABK:J06.9", "HI*ABF:R05.9", "SV1*HC:99213*150*UN*1***1",
    "DTP*472*D8*20230115", "SV1*HC:99214:25*350*UN*1***1", "DTP*472*D8*20230115",
    "CLM*CLM-002*800***11:B:1*Y*A*Y*Y", "DTP*472*D8*20230120", "HI*ABK:M54.5",
    "SV1*HC:99212*250*UN*1***1", "DTP*472*D8*20230120", "SV1*HC:97140*550*UN*2***1",
    "DTP*472*D8*20230120", "SE*22*0001", "GE*1*1", "IEA*1*000000001"]) + "~"

SAMPLE_835 = isa(sender="PAYER", control="000000002") + "~".join([
    "GS*HP*PAYER*PROVIDER*20230201*1200*2*X*005010X221A1", "ST*835*0002*005010X221A1",
    "BPR*I*1200*C*ACH", "TRN*1*TRACE001*1234567890", "DTM*050*20230201", "N1*PR*TEST PAYER",
    "CLP*CLM-001*1*1500*1200*100**MC*CTRL001", "CAS*CO*45*200", "CAS*PR*2*100", "LQ*HE*N130",
    "CLP*CLM-002*4*800*0*0**MC*CTRL002", "CAS*CO*50*800", "LQ*HE*N657", "SE*14*0002",
    "GE*1*2", "IEA*1*000000002"]) + "~"

FILES = {
    "sample837.edi": SAMPLE_837,
    "sample835.edi": SAMPLE_835,
    "noisa.txt": "hello world",
    "shortisa.edi": isa()[:100],
    "untyped.edi": isa() + "GS*X~SE*1~",
    "secondst.edi": text("999", "ST*837*2", "CLM*S1*10***11"),
    "twoisa.edi": text("837", "CLM*T1*10***11", isa(sender="OTHER", control="7")[:-1]),
    "otherseps.x12": text("837", "CLM*O1*10***11:B:1", "SV1*HC:1:A*5*UN*2*12", "HI*ABK:X",
                          e="|", c="^", t="\n"),
    "latin.edi": text("837", "N1*PR*Caf\xe9", "CLM*L1*10***:B:1").encode("latin-1"),
    "badclm.edi": text("837", "CLM*B1*10***11", "SV1*HC:1*1*UN*1", "CLM*B2****11",
                       "SV1*HC:2*2*UN*1", "CLM**5", "CLM*B3*10***11", "SV1*HC:3*3*UN*1"),
    "early.edi": text("837", "SV1*HC:1*1*UN*1", "HI*ABK:X", "DTP*472*D8*20230101",
                      "CLM*E1*10***11"),
    "units.edi": text("837", "CLM*U1*10***11", "SV1*HC:1*1*UN*0", "SV1*HC:2*1*UN*x",
                      "SV1*HC:3*1*UN", "SV1*HC:4*1*UN*0.00", "SV1*HC:5*1.005*UN*2.5",
                      "SV1*HC:*1", "SV1*HC:6*abc"),
    "dtp.edi": text("837", "CLM*D1*10***11", "SV1*HC:1*1*UN*1", "SV1*HC:*2*UN*1",
                    "DTP*472*D8*20230102", "DTP*472*D8*20230231", "DTP*472*RD8*20230101-20230105",
                    "HI*ABK:X", "DTP*472*D8*20230305", "DTP*434*D8*20230401"),
    "carry.edi": text("837", "NM1*IL*1*D*J****MI*M1", "N1*PR*", "CLM*C1*10***11",
                      "NM1*QC*1*D*J****MI*M2", "NM1*PR*2*NEWPAYER", "REF*F8*OLD1", "REF*F8*OLD2",
                      "CLM*C2*10***11", "NM1*PR*2*", "REF*1W*M3", "CLM*C3*10***11"),
    "hi.edi": text("837", "CLM*H1*10***11", "HI*ABK:A* *ABF*ABF:B", "SV1*HC:1*1*UN*1",
                   "HI*ABJ:*ABF: C ", "CLM*H2*10***11", "HI*ABK:Z"),
    "cas.edi": text("835", "CAS*CO*1*1", "LQ*HE*N1", "CLP*X1*5*10*x*0**12*K1",
                    "CAS*CO*45*x**50*5***9**2*1", "CAS**1*1", "CAS*PR", "LQ*N9", "LQ*", "CLP**1*1",
                    "CLP*X2*1*abc", "CAS*OA*23*7"),
    "dtm.edi": text("835", "CLP*M1*1*10*1", "DTM*050*20230105", "CLP*M2*22*10*1",
                    "DTM*050*20230107", "DTM*050*20231307", "CLP*M1*22*10*1", "CLP*M1*7*10*1"),
    "dup.edi": text("837", "CLM*P1*10***11", "CLM*P1*20***11", "SV1*HC:1*1*UN*1"),
    "longname.edi": text("837", "ABCDEFGHIJK*1", "CLM*N1*10***11"),
    "longpos.edi": text("837", "CLM*N2*10***11", "SV1*HC:1*1*UN*1*111"),
    "bigcharge.edi": text("837", "CLM*N3*1e11***11"),
    "longf8.edi": text("837", "CLM*N4*10***11", "REF*F8*" + "9" * 51, "REF*F8*ok"),
    "badf8.edi": text("837", "CLM*N5*10***11", "REF*F8*" + "9" * 51),
    "late.edi": text("837", "CLM*X1*99***11"),
}


def write_files(names=None) -> str:
    """Write inputs into a new folder with rising times, in the order given."""
    folder = tempfile.mkdtemp(prefix="run-")
    for n, name in enumerate(names or FILES):
        path = Path(folder) / name
        content = FILES[name]
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return folder


def new_folder() -> str:
    return tempfile.mkdtemp(prefix="run-")
