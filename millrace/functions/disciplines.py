"""Engineering disciplines and target roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import STUDENT_ROLE, with_tags

# The disciplines in their order, and the words by which a posting is known to be of one.
DISCIPLINES = {
    "software": [
        "software engineer", "software engineering", "software developer", "application developer", "application engineer", "full stack engineer", "full-stack engineer",
        "frontend engineer", "front-end engineer", "backend engineer", "back-end engineer", "cloud engineer", "site reliability engineer", "sre intern",
    ],
    "electrical": ["electrical engineer", "electrical engineering", "power electronics", "circuit design", " ee intern"],
    "computerEngineering": ["computer engineer", "computer engineering", "computer hardware", "soc design", "vlsi"],
    "mechanical": ["mechanical engineer", "mechanical engineering", "mechanical design", "thermal engineer", "thermal engineering", "fluid dynamics", "cfd engineer"],
    "aerospace": [
        "aerospace engineer", "aerospace engineering", "aeronautical engineer", "aeronautical engineering", "flight systems", "flight test engineer", "propulsion engineer",
        "space systems engineer",
    ],
    "civil": ["civil engineer", "civil engineering", "structural engineer", "structural engineering", "transportation engineer", "geotechnical engineer", "water resources engineer"],
    "chemical": ["chemical engineer", "chemical engineering", "process engineering", "process development engineer"],
    "biomedical": ["biomedical engineer", "biomedical engineering", "bioengineer", "bioengineering", "medical device engineer"],
    "industrial": ["industrial engineer", "industrial engineering", "operations engineer", "operations engineering", "continuous improvement engineer"],
    "materials": ["materials engineer", "materials engineering", "metallurgical engineer", "metallurgy", "polymer engineer"],
    "powerEnergy": ["power engineer", "power engineering", "power systems", "energy engineer", "energy engineering", "grid engineer", "substation engineer"],
    "mechatronics": ["mechatronics engineer", "mechatronics engineering", "electromechanical engineer", "electro-mechanical engineer"],
    "hardware": ["hardware engineer", "hardware engineering", "pcb design", "digital design", "asic"],
    "embedded": ["embedded systems", "embedded software", "embedded engineer", "rtos", "microcontroller"],
    "electronics": ["electronics engineer", "electronic design", "analog circuit", "analog design"],
    "test": ["test engineer", "test engineering", "validation engineer", "quality engineer", "qa engineer"],
    "manufacturing": ["manufacturing engineer", "manufacturing engineering", "process engineer", "production engineer"],
    "semiconductor": ["semiconductor", "fab engineer", "wafer fab", "chip design", "silicon engineer"],
    "fpga": ["fpga", "digital hardware", "verilog", "vhdl", "hdl design"],
    "controls": ["controls engineer", "control systems engineer", "automation engineer", "plc programming", "scada"],
    "robotics": ["robotics engineer", "robotics intern", "autonomous systems", "motion control"],
    "systemsEngineering": ["systems engineer", "systems engineering", "requirements engineering"],
    "engineeringTechnician": ["engineering technician", "engineering tech intern", "lab technician"],
    "fieldApplications": ["field applications engineer", "field application engineer", "fae intern"],
    "firmware": ["firmware engineer", "firmware intern", "firmware development"],
}


def with_roles(rows: DataFrame, title: Column, description: Column, disciplines: str, target: str) -> DataFrame:
    """``rows`` with two columns: the disciplines, in their order, of which title or description has a word (an empty list for
    none), and whether the title names a student's role and there is a discipline."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    found = with_tags(rows, said, DISCIPLINES, disciplines)
    return found.withColumn(target, F.coalesce(title.rlike(STUDENT_ROLE), F.lit(False)) & (F.size(disciplines) > 0))
