"""Everything the engine rejects."""


class RelsatError(Exception):
    """Base of all errors of this library."""


class ParseError(RelsatError): ...
class ModuleError(RelsatError): ...
class DuplicateTable(RelsatError): ...
class DuplicateType(RelsatError): ...
class UnknownType(RelsatError): ...
class UnknownTable(RelsatError): ...
class UnknownConstructor(RelsatError): ...
class UnknownGroup(RelsatError): ...
class UndefinedVariable(RelsatError): ...
class TypeMismatch(RelsatError): ...
class WidthMismatch(RelsatError): ...
class LiteralOutOfRange(RelsatError): ...
class MergeRequired(RelsatError): ...
class MergeOnNonNumeric(RelsatError): ...
class OrderOnClass(RelsatError): ...
class UnionOfBaseValues(RelsatError): ...
class VariableInExtract(RelsatError): ...
class Diverged(RelsatError): ...
