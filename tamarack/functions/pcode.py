"""Numbers in compiled code as column expressions: opcodes of older versions, identifiers by their codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# By version, what is added to opcodes up to each bound to give those of version 7 in 64 bits. Above the
# last bound (None) the last number is added. "6" stands for versions 6 and 7 in 32 bits.
OPCODE_SHIFTS = {
    "3": ((67, 0), (70, 2), (111, 4), (150, 8), (164, 9), (166, 10), (169, 11), (238, 12), (None, 24)),
    "5": ((68, 0), (71, 1), (112, 3), (151, 7), (165, 8), (167, 9), (170, 10), (None, 11)),
    "6": ((173, 0), (175, 1), (178, 2), (None, 3)),
}
#: Codes from here on are a project's own identifiers, those below are reserved names.
FIRST_OWN = 0x100


def translate_opcode(opcode: Column, version: Column, is_64bit: Column) -> Column:
    """The version 7, 64-bit number of an opcode of a version (3, 5, 6 or 7; null where an argument is null)."""

    def shifted(steps):
        out = F.when(F.lit(False), F.lit(0))
        for bound, shift in steps:
            out = out.otherwise(shift) if bound is None else out.when(opcode <= bound, shift)
        return opcode + out

    newer = F.when(is_64bit, opcode).when(~is_64bit, shifted(OPCODE_SHIFTS["6"]))
    return F.when(version == 3, shifted(OPCODE_SHIFTS["3"])).when(version == 5, shifted(OPCODE_SHIFTS["5"])).when(version.isNotNull(), newer)


def identifier_name(code: Column, own: Column, reserved: Column, version: Column, is_64bit: Column) -> Column:
    """The name that an identifier's code of 16 bits stands for; id_ and four hex digits where neither array has it.

    own: the project's identifiers in order, reserved: the names below FIRST_OWN. Version 7 has four entries before
    the own ones, three more in 64 bits, and one number that is not used in each list.
    """
    number, new = F.shiftright(code, 1), version >= 7
    at = number - FIRST_OWN
    entries = F.greatest(F.lit(0), F.greatest(F.lit(0), at - 4) - F.when(is_64bit, 3).otherwise(0))
    at = F.when(new, entries - F.when(entries > 0xBE, 1).otherwise(0)).otherwise(at)
    low = number - F.when(new & (number >= 0xC3), 1).otherwise(0)
    name = F.when(number >= FIRST_OWN, F.get(own, at.cast("int"))).otherwise(F.get(reserved, low.cast("int")))
    return F.coalesce(name, F.format_string("id_%04X", code))
