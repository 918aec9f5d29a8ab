"""Label lists of the coded fields; codes count from 0."""

# The labels in the order of their codes.
FLAGS = ["IsAboveAGL", "NoAutogenSuppression", "NoCrash", "NoFog", "NoShadow", "NoZWrite", "NoZTest"]
DESIGNATORS = ["None", "Left", "Right", "Center", "Water", "A", "B"]
SURFACES = [
    "Concrete", "Grass", "Water", "Asphalt", "Clay", "Snow", "Ice", "Dirt", "Coral", "Gravel", "OilTreated", "SteelMats", "Bituminous",
    "Brick", "Macadam", "Planks", "Sand", "Shale", "Tarmac",
]
SURFACE_EXTRA = {0xFE: "Unknown", 0x200: "UseFs20Material", 0xFF03: "UseFs20ApronMaterial"}
RUNWAY_MARKINGS = [
    "Edges", "Threshold", "FixedDistance", "Touchdown", "Dashes", "Ident", "Precision", "EdgePavement", "SingleEnd", "PrimaryClosed",
    "SecondaryClosed", "PrimaryStol", "SecondaryStol", "AltThreshold", "AltFixedDistance", "AltTouchdown", "AltPrecision",
    "LeadingZeroIdent", "NoThresholdEndArrows",
]
RUNWAY_LIGHTS = [
    "EdgeNone", "EdgeLowIntensity", "EdgeMediumIntensity", "EdgeHighIntensity", "CenterNone", "CenterLowIntensity", "CenterMediumIntensity",
    "CenterHighIntensity", "CenterRed",
]
RUNWAY_PATTERNS = ["PrimaryTakeoff", "PrimaryLanding", "PrimaryPattern", "SecondaryTakeoff", "SecondaryLanding", "SecondaryPattern"]
APPROACH_LIGHTS = ["None", "ODALS", "MALSF", "MALSR", "SSALF", "SSALR", "ALSF1", "ALSF2", "RAIL", "CALVERT", "CALVERT2", "MALS", "SALS", "SALSF", "SSALS"]
START_TYPES = ["Runway", "Water", "Helipad"]
TAXI_POINTS = ["Unknown", "Normal", "HoldShort", "IlsHoldShort", "HoldShortNoDraw", "IlsHoldShortNoDraw"]
TAXI_ORIENTATIONS = ["Forward", "Reverse"]
PARKING_PUSHBACKS = ["None", "Left", "Right", "Both"]
PARKING_TYPES = [
    "None", "RampGa", "RampGaSmall", "RampGaMedium", "RampGaLarge", "RampCargo", "RampMilCargo", "RampMilCombat", "GateSmall", "GateMedium",
    "GateHeavy", "DockGa", "Fuel", "Vehicle", "RampGaExtra", "GateExtra",
]
PARKING_NAMES = [
    "None", "Parking", "NParking", "NeParking", "EParking", "SeParking", "SParking", "SwParking", "WParking", "NwParking", "Gate", "Dock",
    *(f"Gate{chr(65 + i)}" for i in range(26)),
]
PATH_TYPES = ["Unknown", "Taxi", "Runway", "Parking", "Path", "Closed", "Vehicle", "Road"]
EDGE_TYPES = ["None", "Solid", "Dashed", "SolidDashed"]
PATH_MATERIALS = ["BaseTiled", "Border", "Center"]
HELIPAD_TYPES = ["None", "H", "Square", "Circle", "Medical"]
TRUE_ANGLES = ["None", "Begin", "End", "BothEnds", "AllPoints"]
VASI_CHILDREN = ["PrimaryLeft", "PrimaryRight", "SecondaryLeft", "SecondaryRight"]
VASI_TYPES = ["Vasi21", "Vasi31", "Vasi22", "Vasi32", "Vasi33", "Papi1", "Papi2", "Tricolor", "PVasi", "TVasi", "Ball", "ApapPanels"]
PAINTED_LINES = [
    "Default", "HoldShortForward", "HoldShortBackward", "HoldShortForwardMarked", "HoldShortBackwardMarked", "IlsHoldShort", "EdgeLineSolid",
    "EdgeLineDashed", "HoldShortTaxiway", "ServiceDashed", "EdgeServiceSolid", "EdgeServiceDashed", "WideYellow", "WideWhite", "WideRed",
    "SlimRed", "EdgeSolidOrtho", "EdgeSolidOrthoBack", "NonMovement", "NonMovementBack", "EnhancedCenter", "DefaultLighted",
    "HoldShortForwardMarkedL", "HoldShortBackwardMarkedL", "HoldShortForwardLighted", "HoldShortBackwardLighted", "IlsHoldShortLighted",
    "EdgeLineSolidLighted", "EdgeLineDashedLighted", "HoldShortTaxiwayLighted", "ServiceDashedLighted", "EdgeServiceSolidLighted",
    "EdgeServiceDashedLighted", "WideYellowLighted", "WideWhiteLighted", "WideRedLighted", "SlimRedLighted", "EdgeSolidOrthoLighted",
    "EdgeSolidOrthoBackLight", "NonMovementLighted", "NonMovementBackLighted", "EnhancedCenterLighted",
]
LEG_TYPES = ["Af", "Ca", "Cd", "Cf", "Ci", "Cr", "Df", "Fa", "Fc", "Fd", "Fm", "Ha", "Hf", "Hm", "If", "Pi", "Rf", "Tf", "Va", "Vd", "Vi", "Vm", "Vr"]
ALTITUDE_DESCRIPTORS = ["Empty", "A", "Plus", "Minus", "B", "C", "G", "H", "I", "J", "V"]
TURN_DIRECTIONS = ["Null", "Left", "Right", "Either"]
APPROACH_TYPES = ["Unknown", "Gps", "Vor", "Ndb", "Ils", "Localizer", "Sdf", "Lda", "Vordme", "Ndbdme", "Rnav", "LocalizerBackcourse"]
FIX_TYPES = ["Unknown", "Airport", "Vor", "Ndb", "TerminalNdb", "Waypoint", "TerminalWaypoint", "Localizer", "Runway"]

ENUMS = {
    "designator": DESIGNATORS, "surface": SURFACES, "runway_marking": RUNWAY_MARKINGS, "runway_light": RUNWAY_LIGHTS,
    "runway_pattern": RUNWAY_PATTERNS, "approach_light": APPROACH_LIGHTS, "start_type": START_TYPES, "taxi_point": TAXI_POINTS,
    "taxi_orientation": TAXI_ORIENTATIONS, "parking_name": PARKING_NAMES, "parking_pushback": PARKING_PUSHBACKS, "parking_type": PARKING_TYPES,
    "path_type": PATH_TYPES, "edge_type": EDGE_TYPES, "path_material": PATH_MATERIALS, "helipad_type": HELIPAD_TYPES, "true_angle": TRUE_ANGLES,
    "vasi_child": VASI_CHILDREN, "flag": FLAGS, "vasi_type": VASI_TYPES, "painted_line": PAINTED_LINES, "leg_type": LEG_TYPES,
    "altitude_descriptor": ALTITUDE_DESCRIPTORS, "turn_direction": TURN_DIRECTIONS, "approach_type": APPROACH_TYPES, "fix_type": FIX_TYPES,
}


def rows() -> list[tuple[str, int, str]]:
    """(enum, code, label) of every label."""
    extra = [("surface", code, label) for code, label in SURFACE_EXTRA.items()]
    return [(enum, code, label) for enum, labels in ENUMS.items() for code, label in enumerate(labels)] + extra
