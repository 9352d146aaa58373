"""The codecs' columns in the JVM: `Codec.java`, compiled by the compiler that Spark brings along and sent to the executors.

A session without a JVM at hand (Spark Connect), or whose Spark lacks that compiler, has none; the codecs then run in Python, with
the same bytes.
"""

from __future__ import annotations

import atexit
import os
import pkgutil
import shutil
import tempfile
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions.binary import KEY_HIGH, KEY_LOW, as_column
from bytequarry.functions.formats import IMAGE_MAGIC, PACKED_SCRIPT_MAGIC

#: The codec of a context, by its application.
_MADE: dict = {}


def _codec(spark: SparkSession):
    """The function of (what, bytes) as Spark's JVM has it, or None; compiled once a context."""
    context = getattr(spark, "_sc", None)
    if context is None:
        return None
    if context.applicationId not in _MADE:
        _MADE.clear()
        try:
            _MADE[context.applicationId] = _made(context)
        except (Py4JError, TypeError):  # a name that the JVM does not know is a package, which can't be called
            _MADE[context.applicationId] = None
    return _MADE[context.applicationId]


def _made(context):
    jvm = context._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook((pkgutil.get_data(__package__, "Codec.java") or b"").decode())
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    jar = os.path.join(folder, "bytequarry-codec.jar")
    with zipfile.ZipFile(jar, "w") as out:
        classes = compiler.getBytecodes()
        for name in list(classes.keySet()):
            out.writestr(name.replace(".", "/") + ".class", bytes(classes.get(name)))
    context._jsc.addJar(jar)
    of = compiler.getClassLoader().loadClass

    def array(kind, *items):
        out = context._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    codec = of("bytequarry.Codec").getConstructors()[0].newInstance(array(jvm.Object, bytearray(PACKED_SCRIPT_MAGIC), bytearray(IMAGE_MAGIC), KEY_LOW, KEY_HIGH))
    # by its parameters: Py4J may as well take the udf of any object
    udf = of("org.apache.spark.sql.functions").getMethod("udf", array(jvm.Class, of("org.apache.spark.sql.api.java.UDF2"), of("org.apache.spark.sql.types.DataType")))
    return udf.invoke(None, array(jvm.Object, codec, jvm.org.apache.spark.sql.types.DataTypes.BinaryType))


def column(spark: SparkSession, what: Column | str, data: Column | str) -> Column | None:
    """What Codec.call makes of the bytes, or None for a session that can't.

    what: "pack" (dsc.encode), "dsc" (dsc.decode), "paint" (image.encode of the pixels after 4 bytes of width), "image" (the pixels of
    image.decode for version 1). Null for what is left to those functions: anything that is not plainly sound.
    """
    codec = _codec(spark)
    if codec is None:
        return None
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    what = F.lit(what) if isinstance(what, str) else what
    return Column(codec.apply(_to_seq(spark._sc, [what, as_column(data)], _to_java_column)))
