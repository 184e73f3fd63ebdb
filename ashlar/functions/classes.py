"""Entity classes: take-off modes and the class hierarchy, as small dimension tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity names by take-off mode. They must agree with published results.
SKIP = """
IfcSpace IfcOpeningElement IfcOpeningStandardCase IfcProjectionElement IfcVoidingFeature IfcSurfaceFeature IfcGrid IfcGridAxis IfcAnnotation
IfcVirtualElement IfcSpatialZone IfcDistributionPort IfcPort IfcAlignment IfcAlignmentSegment IfcAlignmentHorizontal IfcAlignmentVertical
IfcAlignmentCant IfcReferent IfcLinearPositioningElement IfcPositioningElement IfcFacility IfcFacilityPart IfcFacilityPartCommon IfcBridge
IfcBridgePart IfcRoad IfcRoadPart IfcRailway IfcRailwayPart IfcMarineFacility IfcMarinePart
""".split()
COUNT = """
IfcFurnishingElement IfcSystemFurnitureElement IfcFurniture IfcSanitaryTerminal IfcMedicalDevice IfcLamp IfcLightFixture IfcElectricAppliance
IfcElectricFlowStorageDevice IfcElectricGenerator IfcElectricMotor IfcOutlet IfcSwitchingDevice IfcProtectiveDevice IfcAudioVisualAppliance
IfcCommunicationsAppliance IfcTransformer IfcMotorConnection IfcJunctionBox IfcCableFitting IfcAirTerminal IfcAirTerminalBox
IfcFireSuppressionTerminal IfcSpaceHeater IfcSensor IfcAlarm IfcController IfcActuator IfcFlowMeter IfcValve IfcFan IfcPump IfcCompressor
IfcChiller IfcBoiler IfcCoolingTower IfcHeatExchanger IfcHumidifier IfcEvaporator IfcCondenser IfcEvaporativeCooler IfcUnitaryEquipment IfcTank
IfcFilter IfcDamper IfcPipeFitting IfcDuctFitting IfcDuctSilencer IfcDistributionChamberElement IfcDoor IfcDoorStandardCase IfcWindow
IfcWindowStandardCase IfcDiscreteAccessory IfcFastener IfcMechanicalFastener IfcVibrationIsolator IfcVibrationDamper IfcCableCarrierFitting
IfcBuildingElementPart IfcTransportElement IfcElementAssembly IfcImpactProtectionDevice IfcMooringDevice IfcNavigationElement IfcSign
IfcVehicle IfcTransportationDevice
""".split()
LINEAR = "IfcPipeSegment IfcDuctSegment IfcCableSegment IfcCableCarrierSegment IfcRailing".split()
MEASURE = """
IfcWall IfcWallStandardCase IfcWallElementedCase IfcSlab IfcSlabStandardCase IfcSlabElementedCase IfcRoof IfcFooting IfcPile IfcChimney IfcBeam
IfcBeamStandardCase IfcColumn IfcColumnStandardCase IfcMember IfcMemberStandardCase IfcPlate IfcPlateStandardCase IfcCovering IfcCurtainWall
IfcStair IfcStairFlight IfcRamp IfcRampFlight IfcShadingDevice IfcBuildingElementProxy IfcReinforcingBar IfcReinforcingMesh
IfcReinforcingElement IfcTendon IfcTendonAnchor IfcTendonConduit IfcProxy IfcCivilElement IfcGeographicElement
""".split()
#: Classes whose subclasses count, and those whose subclasses are measured along their length or as bodies.
COUNT_PARENTS = "IfcFlowTerminal IfcFlowController IfcFlowMovingDevice IfcFlowStorageDevice IfcFlowTreatmentDevice IfcEnergyConversionDevice IfcDistributionControlElement".split()
LINEAR_PARENTS, MEASURE_PARENTS = ["IfcFlowSegment"], ["IfcBuildingElement", "IfcBuiltElement"]

#: The public IFC4 class hierarchy as far as products go: a parent, then its children.
HIERARCHY = """
IfcProduct: IfcElement IfcSpatialElement IfcPort IfcPositioningElement IfcAnnotation IfcProxy IfcGrid
IfcSpatialElement: IfcSpatialStructureElement IfcSpatialZone
IfcSpatialStructureElement: IfcSite IfcBuilding IfcBuildingStorey IfcSpace IfcFacility
IfcElement: IfcBuildingElement IfcDistributionElement IfcElementAssembly IfcElementComponent IfcFeatureElement IfcFurnishingElement IfcTransportElement IfcVirtualElement IfcCivilElement IfcGeographicElement
IfcBuildingElement: IfcWall IfcSlab IfcRoof IfcFooting IfcPile IfcChimney IfcBeam IfcColumn IfcMember IfcPlate IfcCovering IfcCurtainWall IfcStair IfcStairFlight IfcRamp IfcRampFlight IfcRailing IfcDoor IfcWindow IfcShadingDevice IfcBuildingElementProxy
IfcWall: IfcWallStandardCase IfcWallElementedCase
IfcSlab: IfcSlabStandardCase IfcSlabElementedCase
IfcBeam: IfcBeamStandardCase
IfcColumn: IfcColumnStandardCase
IfcMember: IfcMemberStandardCase
IfcPlate: IfcPlateStandardCase
IfcDoor: IfcDoorStandardCase
IfcWindow: IfcWindowStandardCase
IfcElementComponent: IfcBuildingElementPart IfcDiscreteAccessory IfcFastener IfcMechanicalFastener IfcReinforcingElement IfcVibrationIsolator
IfcReinforcingElement: IfcReinforcingBar IfcReinforcingMesh IfcTendon IfcTendonAnchor
IfcFeatureElement: IfcFeatureElementSubtraction IfcFeatureElementAddition IfcSurfaceFeature
IfcFeatureElementSubtraction: IfcOpeningElement IfcVoidingFeature
IfcFeatureElementAddition: IfcProjectionElement
IfcOpeningElement: IfcOpeningStandardCase
IfcFurnishingElement: IfcFurniture IfcSystemFurnitureElement
IfcDistributionElement: IfcDistributionControlElement IfcDistributionFlowElement
IfcDistributionControlElement: IfcSensor IfcAlarm IfcController IfcActuator IfcUnitaryControlElement IfcFlowInstrument IfcProtectiveDeviceTrippingUnit
IfcDistributionFlowElement: IfcFlowSegment IfcFlowFitting IfcFlowTerminal IfcFlowController IfcFlowMovingDevice IfcFlowStorageDevice IfcFlowTreatmentDevice IfcEnergyConversionDevice IfcDistributionChamberElement
IfcFlowSegment: IfcPipeSegment IfcDuctSegment IfcCableSegment IfcCableCarrierSegment
IfcFlowFitting: IfcPipeFitting IfcDuctFitting IfcCableFitting IfcCableCarrierFitting IfcJunctionBox
IfcFlowTerminal: IfcAirTerminal IfcAudioVisualAppliance IfcCommunicationsAppliance IfcElectricAppliance IfcFireSuppressionTerminal IfcLamp IfcLightFixture IfcMedicalDevice IfcOutlet IfcSanitaryTerminal IfcSpaceHeater IfcStackTerminal IfcWasteTerminal
IfcFlowController: IfcAirTerminalBox IfcDamper IfcElectricDistributionBoard IfcElectricTimeControl IfcFlowMeter IfcProtectiveDevice IfcSwitchingDevice IfcValve
IfcFlowMovingDevice: IfcFan IfcPump IfcCompressor
IfcFlowStorageDevice: IfcTank IfcElectricFlowStorageDevice
IfcFlowTreatmentDevice: IfcFilter IfcDuctSilencer IfcInterceptor
IfcEnergyConversionDevice: IfcAirToAirHeatRecovery IfcBoiler IfcBurner IfcChiller IfcCoil IfcCondenser IfcCooledBeam IfcCoolingTower IfcElectricGenerator IfcElectricMotor IfcEngine IfcEvaporativeCooler IfcEvaporator IfcHeatExchanger IfcHumidifier IfcMotorConnection IfcSolarDevice IfcTransformer IfcTubeBundle IfcUnitaryEquipment
IfcPort: IfcDistributionPort
"""


#: What the other schemas hold in place of a line of the above; lines with a new parent come on top, and a bar drops one.
CHANGES = {
    "IFC4": "",
    "IFC4X3": """
IfcElement: IfcBuiltElement IfcDistributionElement IfcElementAssembly IfcElementComponent IfcFeatureElement IfcFurnishingElement IfcTransportationDevice IfcVirtualElement IfcCivilElement IfcGeographicElement IfcGeotechnicalElement
IfcBuildingElement: |
IfcBuiltElement: IfcWall IfcSlab IfcRoof IfcFooting IfcDeepFoundation IfcEarthworksElement IfcChimney IfcBeam IfcBearing IfcColumn IfcCourse IfcKerb IfcMember IfcMooringDevice IfcNavigationElement IfcPavement IfcPlate IfcCovering IfcCurtainWall IfcRail IfcStair IfcStairFlight IfcRamp IfcRampFlight IfcRailing IfcDoor IfcTrackElement IfcWindow IfcShadingDevice IfcBuildingElementProxy
IfcDeepFoundation: IfcPile IfcCaissonFoundation
IfcEarthworksElement: IfcEarthworksFill IfcReinforcedSoil
IfcTransportationDevice: IfcTransportElement IfcVehicle
IfcGeotechnicalElement: IfcGeotechnicalAssembly IfcGeotechnicalStratum
IfcFeatureElementSubtraction: IfcOpeningElement IfcVoidingFeature IfcEarthworksCut
IfcElementComponent: IfcBuildingElementPart IfcDiscreteAccessory IfcFastener IfcImpactProtectionDevice IfcMechanicalFastener IfcReinforcingElement IfcSign IfcVibrationDamper IfcVibrationIsolator
IfcReinforcingElement: IfcReinforcingBar IfcReinforcingMesh IfcTendon IfcTendonAnchor IfcTendonConduit
IfcFlowSegment: IfcPipeSegment IfcDuctSegment IfcCableSegment IfcCableCarrierSegment IfcConveyorSegment
IfcSpatialStructureElement: IfcSite IfcBuildingStorey IfcSpace IfcFacility IfcFacilityPart
IfcFacility: IfcBridge IfcBuilding IfcMarineFacility IfcRailway IfcRoad
IfcFacilityPart: IfcBridgePart IfcFacilityPartCommon IfcMarinePart IfcRailwayPart IfcRoadPart
IfcPositioningElement: IfcGrid IfcLinearPositioningElement IfcReferent
IfcLinearPositioningElement: IfcAlignment
""",
    "IFC2X3": """
IfcProduct: IfcElement IfcSpatialStructureElement IfcPort IfcAnnotation IfcProxy IfcGrid
IfcSpatialElement: |
IfcSpatialStructureElement: IfcSite IfcBuilding IfcBuildingStorey IfcSpace
IfcElement: IfcBuildingElement IfcDistributionElement IfcElectricalElement IfcElementAssembly IfcElementComponent IfcEquipmentElement IfcFeatureElement IfcFurnishingElement IfcTransportElement IfcVirtualElement
IfcBuildingElement: IfcWall IfcSlab IfcRoof IfcFooting IfcPile IfcBeam IfcBuildingElementComponent IfcColumn IfcMember IfcPlate IfcCovering IfcCurtainWall IfcStair IfcStairFlight IfcRamp IfcRampFlight IfcRailing IfcDoor IfcWindow IfcBuildingElementProxy
IfcBuildingElementComponent: IfcBuildingElementPart IfcReinforcingElement
IfcElementComponent: IfcDiscreteAccessory IfcFastener
IfcFastener: IfcMechanicalFastener
IfcWall: IfcWallStandardCase
IfcSlab: |
IfcBeam: |
IfcColumn: |
IfcMember: |
IfcPlate: |
IfcDoor: |
IfcWindow: |
IfcOpeningElement: |
IfcFurnishingElement: |
IfcFeatureElement: IfcFeatureElementSubtraction IfcFeatureElementAddition
IfcFeatureElementSubtraction: IfcOpeningElement IfcEdgeFeature
IfcEdgeFeature: IfcChamferEdgeFeature IfcRoundedEdgeFeature
IfcDistributionControlElement: |
IfcFlowSegment: |
IfcFlowFitting: |
IfcFlowTerminal: |
IfcFlowController: IfcElectricDistributionPoint
IfcFlowMovingDevice: |
IfcFlowStorageDevice: |
IfcFlowTreatmentDevice: |
IfcEnergyConversionDevice: |
""",
}


def resolve_schema(name: str | None) -> str | None:
    """The known schema that a header's name means: in any letter case, with any suffix, the longest that fits."""
    fits = [s for s in CHANGES if (name or "").upper().startswith(s)]
    return max(fits, key=len, default=None)


def _lines(text: str) -> dict[str, list[str]]:
    return {head: rest.split() for line in text.strip().splitlines() for head, rest in [line.split(":")]}


@cache
def parents(schema: str = "IFC4") -> dict[str, str]:
    """Each class's parent in a schema; unknown schemas count as IFC4."""
    known = _lines(HIERARCHY) | _lines(CHANGES[resolve_schema(schema) or "IFC4"])
    return {child: head for head, rest in known.items() if rest != ["|"] for child in rest}


@cache
def everything() -> frozenset[str]:
    """Every class named in any schema or mode."""
    return frozenset({*SKIP, *COUNT, *LINEAR, *MEASURE, *COUNT_PARENTS}.union(*({*parents(s), *parents(s).values()} for s in CHANGES)))


def ancestors(entity: str, schema: str = "IFC4") -> list[str]:
    """A class and what it descends from, nearest first."""
    up, out = parents(schema), [entity]
    while out[-1] in up:
        out.append(up[out[-1]])
    return out


def mode_of(entity: str, schema: str = "IFC4") -> str:
    """skip, count, linear or measure: by the entity's own name, then by its ancestors in the schema, else skip."""
    for mode, names in (("skip", SKIP), ("count", COUNT), ("linear", LINEAR), ("measure", MEASURE)):
        if entity in names:
            return mode
    for name in ancestors(entity, schema):
        for mode, names in (("count", COUNT_PARENTS), ("linear", LINEAR_PARENTS), ("measure", MEASURE_PARENTS)):
            if name in names:
                return mode
    return "skip"


def mode_column(entity: Column, schema: str = "IFC4") -> Column:
    """mode_of as an expression; a literal map, so no join."""
    table = F.create_map(*[F.lit(x) for name in sorted(everything()) for x in (name, mode_of(name, schema))])
    return F.coalesce(F.element_at(table, entity), F.lit("skip"))


def product_names(schema: str = "IFC4") -> list[str]:
    """Upper-case names of the classes whose records are products: all elements of the schema, and those that have a mode."""
    spatial = {n for n in everything() for s in CHANGES if {"IfcSpatialStructureElement", "IfcFacility", "IfcFacilityPart"} & {*ancestors(n, s)}} - {"IfcSpace"}
    elements = {c for c in {*parents(schema), *parents(schema).values()} if "IfcElement" in ancestors(c, schema)}
    return sorted(n.upper() for n in (elements | {*SKIP, *COUNT, *LINEAR, *MEASURE}) - spatial)


def closure(spark: SparkSession) -> DataFrame:
    """(schema, entity, ancestor): the hierarchies' reflexive closures, a few thousand rows."""
    rows = sorted((s, c, a) for s in CHANGES for c in {*parents(s), *parents(s).values()} for a in ancestors(c, s))
    return spark.createDataFrame(rows, "schema string, entity string, ancestor string")


def subtypes(entity: str, schema: str = "IFC4") -> list[str]:
    """A class and all below it in a schema; the name in any letter case. Names unknown to every schema raise."""
    exact = {n.lower(): n for n in everything()}.get(entity.lower())
    if exact is None:
        raise ValueError(f"unknown entity {entity!r}")
    return sorted({exact} | {n for n in {*parents(schema), *parents(schema).values()} if exact in ancestors(n, schema)})


def canonical(name: Column) -> Column:
    """The proper case of an upper-case class name; unknown ones are Ifc and a capitalised rest."""
    table = F.create_map(*[F.lit(x) for n in sorted(everything()) for x in (n.upper(), n)])
    upper = F.upper(name)
    return F.coalesce(F.element_at(table, upper), F.concat(F.lit("Ifc"), F.upper(F.substring(upper, 4, 1)), F.lower(F.substring(upper, 5, 1000))))
