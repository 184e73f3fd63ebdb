"""A small model of one's own to try things on: a house of one storey with a wall, a window and a table of facts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .api import Model
from .sources.step import store

TEXT = """ISO-10303-21;
HEADER;
FILE_DESCRIPTION(('example'),'2;1');
FILE_NAME('house.ifc','2024-01-01T00:00:00',(''),(''),'','ashlar','');
FILE_SCHEMA(('IFC4'));
ENDSEC;
DATA;
#1=IFCPROJECT('Project000000000000001',$,'House',$,$,$,$,$,#4);
#2=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);
#4=IFCUNITASSIGNMENT((#2));
#5=IFCSITE('Site000000000000000001',$,'Site',$,$,$,$,$,.ELEMENT.,$,$,$,$,$);
#6=IFCBUILDING('Building00000000000001',$,'House',$,$,$,$,$,.ELEMENT.,$,$,$);
#7=IFCBUILDINGSTOREY('Storey0000000000000001',$,'Ground',$,$,$,$,$,.ELEMENT.,0.);
#8=IFCRELAGGREGATES('Aggregates000000000001',$,$,$,#1,(#5));
#9=IFCRELAGGREGATES('Aggregates000000000002',$,$,$,#5,(#6));
#10=IFCRELAGGREGATES('Aggregates000000000003',$,$,$,#6,(#7));
#11=IFCWALL('Wall000000000000000001',$,'Wall',$,$,#20,#21,'W1',.STANDARD.);
#12=IFCOPENINGELEMENT('Opening000000000000001',$,'Hole',$,$,#30,#31,$,.OPENING.);
#13=IFCRELCONTAINEDINSPATIALSTRUCTURE('Contained0000000000001',$,$,$,(#11),#7);
#14=IFCRELVOIDSELEMENT('Voids00000000000000001',$,$,$,#11,#12);
#15=IFCPROPERTYSET('Pset000000000000000001',$,'Pset_WallCommon',$,(#16));
#16=IFCPROPERTYSINGLEVALUE('IsExternal',$,IFCBOOLEAN(.T.),$);
#17=IFCRELDEFINESBYPROPERTIES('Defines000000000000001',$,$,$,(#11),#15);
#20=IFCLOCALPLACEMENT($,#22);
#21=IFCPRODUCTDEFINITIONSHAPE($,$,(#23));
#22=IFCAXIS2PLACEMENT3D(#40,$,$);
#23=IFCSHAPEREPRESENTATION($,'Body','CSG',(#24));
#24=IFCBLOCK(#22,4000.,300.,2500.);
#30=IFCLOCALPLACEMENT(#20,#32);
#31=IFCPRODUCTDEFINITIONSHAPE($,$,(#33));
#32=IFCAXIS2PLACEMENT3D(#41,$,$);
#33=IFCSHAPEREPRESENTATION($,'Body','CSG',(#34));
#34=IFCBLOCK(#22,1000.,300.,1000.);
#40=IFCCARTESIANPOINT((0.,0.,0.));
#41=IFCCARTESIANPOINT((1500.,0.,900.));
ENDSEC;
END-ISO-10303-21;
"""


def write_example(path: str) -> str:
    files, inner = store(path)
    with files.open_output_stream(inner) as f:
        f.write(TEXT.encode())
    return path


def example_model(spark: SparkSession, path: str) -> Model:
    """The example as a model, written to a path that executors can read."""
    return Model(spark, write_example(path))
