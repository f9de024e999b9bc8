"""Rays of neighbouring observers walked together, by the Java that runs Spark.

Observers beside each other on a row have rays of the same shape to a horizontal edge, so one
walk serves a whole run of them, cell after cell from contiguous memory; the transposed grid serves
the vertical edges.  Of whole elevations a slope is compared as a product; where that is too close to
tell, and for other elevations, slopes are divided, so that every decision is that of ``los.Terrain.walk``.

A task has one child process, which ends with the task's pipe.  Where it cannot be started (no
compiler or vector module beside that Java) ``los.Terrain.near`` does the work.
"""

from __future__ import annotations

import math
import os
import shutil
import struct
import subprocess
import tempfile

import numpy as np

SOURCE = r"""
import java.io.*;
import java.nio.*;
import jdk.incubator.vector.*;

public class Rays {
    static final VectorSpecies<Double> S = DoubleVector.SPECIES_PREFERRED;
    static final int L = S.length();
    static int downs, rights;  // reach
    static double height;  // NaN: not all values are whole and all towers the same
    static double[][] z = new double[2][], tower = new double[2][];  // the grid and its transpose
    static long[] seen;  // per offset and row of the block a bit per observer
    static int[] cells, places;
    static double[] dist, level = new double[2 * L];

    /** 2 L observers from ``here`` on along cells beyond the reach, all values being whole; true if a comparison is too close for products. */
    static boolean far(double[] z, int[] cells, double[] dist, double[] level, int here, int steps) {
        double h = height;
        DoubleVector z0 = DoubleVector.fromArray(S, z, here).add(h), v0 = DoubleVector.broadcast(S, -1e300);
        DoubleVector z1 = DoubleVector.fromArray(S, z, here + 1 * L).add(h), v1 = DoubleVector.broadcast(S, -1e300);
        for (int k = 0; k < steps; k++) {
            int c = here + cells[k];
            double d = dist[k], inv = 1 / d;
            DoubleVector b0 = DoubleVector.fromArray(S, z, c).sub(z0), a0 = b0.add(h), g0 = a0.sub(v0.mul(d)), t0 = a0.abs().mul(1e-14);
            DoubleVector b1 = DoubleVector.fromArray(S, z, c + 1 * L).sub(z1), a1 = b1.add(h), g1 = a1.sub(v1.mul(d)), t1 = a1.abs().mul(1e-14);
            v0 = v0.blend(b0.mul(inv), g0.compare(VectorOperators.GT, t0));
            v1 = v1.blend(b1.mul(inv), g1.compare(VectorOperators.GT, t1));
            if (g0.abs().compare(VectorOperators.LE, t0).or(g1.abs().compare(VectorOperators.LE, t1)).anyTrue()) return true;
        }
        v0.intoArray(level, 0);
        v1.intoArray(level, 1 * L);
        return false;
    }

    /** L observers along the cells within the reach, from the levels of ``far`` on. */
    static boolean near(double[] z, int[] cells, double[] dist, int[] places, double[] level, int from, long[] seen, int here, int first, int steps, long live, int shift) {
        double h = height;
        DoubleVector z0 = DoubleVector.fromArray(S, z, here).add(h), v = DoubleVector.fromArray(S, level, from);
        for (int k = first; k < steps; k++) {
            double d = dist[k], inv = 1 / d;
            DoubleVector b = DoubleVector.fromArray(S, z, here + cells[k]).sub(z0), a = b.add(h), g = a.sub(v.mul(d)), t = a.abs().mul(1e-14);
            VectorMask<Double> m = g.compare(VectorOperators.GT, t);
            v = v.blend(b.mul(inv), m);
            if (places[k] >= 0) seen[places[k]] |= (m.toLong() & live) << shift;
            if (g.abs().compare(VectorOperators.LE, t).anyTrue()) return true;
        }
        return false;
    }

    /** One observer along one ray, by divided slopes. */
    static void alone(double[] z, double[] t, int here, long bit, int steps) {
        double level = Double.NEGATIVE_INFINITY, z0 = z[here], h0 = t[here];
        for (int k = 0; k < steps; k++) {
            int c = here + cells[k];
            if ((z[c] + t[c] - z0 - h0) / dist[k] >= level) {
                level = (z[c] - z0 - h0) / dist[k];
                if (places[k] >= 0) seen[places[k]] |= bit;
            }
        }
    }

    static void ray(double[] z, double[] t, int nc, int here, int n, int shift, int dr, int dc, boolean ties, int reachR, int reachC, int stepR, int stepC, int lines, int line) {
        int fr = Math.abs(dr), fc = Math.abs(dc), far = Math.max(reachR, reachC);
        boolean rows = ties ? fr >= fc : fr > fc, swap = (rows ? dr : dc) < 0;
        int dx = rows ? fr : fc, dy = rows ? fc : fr, side = (rows ? dc : dr) < 0 ? -1 : 1, ahead = swap ? -1 : 1;
        int inner = swap ? dx - 1 : Math.min(dx - 1, far), steps = dx > far ? inner : inner + 1, error = dx - 1, moved = 0;
        for (int k = 1; k <= steps; k++) {
            int along = dx, aside = dy;  // the cell on the edge comes last
            if (k <= inner) {
                error += 2 * dy;
                if (error >= 2 * dx) {
                    error -= 2 * dx;
                    moved++;
                }
                along = swap ? dx - k : k;
                aside = swap ? dy - moved : moved;
            }
            int down = rows ? ahead * along : side * aside, right = rows ? side * aside : ahead * along;
            boolean inside = down >= -reachR && down <= reachR && right >= -reachC && right <= reachC;
            cells[k - 1] = down * nc + right;
            dist[k - 1] = Math.sqrt((double) ((long) along * along + (long) aside * aside));
            places[k - 1] = inside ? ((down + reachR) * stepR + (right + reachC) * stepC) * lines + line : -1;
        }
        int reached = 0;
        while (reached < steps && places[reached] < 0) reached++;
        for (int i = 0; i < n; i += 2 * L) {
            int m = Math.min(2 * L, n - i);
            boolean close = Double.isNaN(height) || far(z, cells, dist, level, here + i, reached);
            for (int j = 0; j < m && !close; j += L) close = near(z, cells, dist, places, level, j, seen, here + i + j, reached, steps, (1L << Math.min(L, m - j)) - 1, shift + i + j);
            for (int j = i; j < i + m && close; j++) alone(z, t, here + j, 1L << shift + j, steps);
        }
    }

    /** All rays of the observers (r, lo .. hi - 1) to the first and the last row of a grid; bits are counted from column ``left``. */
    static void row(int side, int nr, int nc, int r, int lo, int hi, int left, int lines, int line) {
        boolean plain = side == 0;
        int first = plain ? 0 : 1, last = plain ? nc - 1 : nc - 2, wide = 2 * rights + 1;
        for (int e = 0; e < (nr > 1 ? 2 : 1); e++)
            for (int dr = (e == 0 ? 0 : nr - 1) - r, dc = first - (hi - 1); dc <= last - lo; dc++) {
                int a = Math.max(lo, first - dc), b = Math.min(hi - 1, last - dc);
                if (a <= b && (dr != 0 || dc != 0))
                    ray(z[side], tower[side], nc, r * nc + a, b - a + 1, a - left, dr, dc, plain, plain ? downs : rights, plain ? rights : downs, plain ? wide : 1, plain ? 1 : wide, lines, line);
            }
    }

    /** Lines of a block, by rows and then by columns. */
    static void lines(int side, int nr, int nc, byte[] asked, int top, int left, int high, int wide, int stepR, int stepC) {
        for (int k = 0; k < high; k++) {
            int lo = 0, hi = wide;
            while (lo < hi && asked[k * stepR + lo * stepC] == 0) lo++;
            while (lo < hi && asked[k * stepR + (hi - 1) * stepC] == 0) hi--;
            if (lo < hi) row(side, nr, nc, top + k, left + lo, left + hi, left, high, k);
        }
    }

    static double[] doubles(DataInputStream in, int n) throws IOException {
        byte[] raw = new byte[1 << 16];
        double[] got = new double[n + 64];  // whole vectors may be read at the end
        for (int k = 0; k < n; k += raw.length / 8) {
            int m = Math.min(raw.length / 8, n - k);
            in.readFully(raw, 0, 8 * m);
            ByteBuffer.wrap(raw).asDoubleBuffer().get(got, k, m);
        }
        return got;
    }

    static double[] turned(double[] x, int nr, int nc) {
        double[] got = new double[x.length];
        for (int r = 0; r < nr; r++) for (int c = 0; c < nc; c++) got[c * nr + r] = x[r * nc + c];
        return got;
    }

    public static void main(String[] args) throws IOException {
        DataInputStream in = new DataInputStream(new BufferedInputStream(System.in, 1 << 16));
        OutputStream out = new FileOutputStream(FileDescriptor.out);
        int nr = in.readInt(), nc = in.readInt();
        downs = in.readInt();
        rights = in.readInt();
        z[0] = doubles(in, nr * nc);
        tower[0] = doubles(in, nr * nc);
        height = in.readDouble();
        z[1] = turned(z[0], nr, nc);
        tower[1] = turned(tower[0], nr, nc);
        int longest = Math.max(nr, nc) + 1, offsets = (2 * downs + 1) * (2 * rights + 1);
        cells = new int[longest];
        places = new int[longest];
        dist = new double[longest];
        out.write(1);
        while (true) {
            int top, left, high, wide;
            try {
                top = in.readInt();
            } catch (EOFException end) {
                return;
            }
            left = in.readInt();
            high = in.readInt();
            wide = in.readInt();
            byte[] asked = new byte[high * wide];
            in.readFully(asked);
            for (int side = 0; side < 2; side++) {
                seen = new long[offsets * (side == 0 ? high : wide)];
                if (side == 0) lines(0, nr, nc, asked, top, left, high, wide, wide, 1);
                else lines(1, nc, nr, asked, left, top, wide, high, 1, wide);
                ByteBuffer raw = ByteBuffer.allocate(8 * seen.length).order(ByteOrder.LITTLE_ENDIAN);
                raw.asLongBuffer().put(seen);
                out.write(raw.array());
            }
        }
    }
}
"""

#: Observers of a block's side: one bit each.
MOST_SIDE = 64


def whole_height(z: np.ndarray, tower: np.ndarray) -> float:
    """The height of all towers if it and all elevations are whole numbers, so that sums of them are exact; else NaN."""
    known, height = z[~np.isnan(z)], float(tower.flat[0])
    exact = (tower == height).all() and height.is_integer() and (known == np.rint(known)).all() and max(abs(height), np.abs(known).max(initial=0)) < 2**40
    return height if exact else math.nan


class Looker:
    """What the observers of a block of the grid see at most ``reach`` rows and columns away."""

    def __init__(self, z: np.ndarray, tower: np.ndarray, reach: tuple[int, int]) -> None:
        home = os.environ.get("JAVA_HOME")
        java = os.path.join(home, "bin", "java") if home and os.path.exists(os.path.join(home, "bin", "java")) else shutil.which("java")
        if java is None:
            raise OSError("no java")
        self.reach = reach
        with tempfile.TemporaryDirectory(prefix="ridgeplan-") as folder:
            source = os.path.join(folder, "Rays.java")
            with open(source, "w") as f:
                f.write(SOURCE)
            offsets = (2 * reach[0] + 1) * (2 * reach[1] + 1)
            heap = 64 + (5 * 8 * z.size + 4 * 8 * MOST_SIDE * offsets >> 20)
            options = [f"-Xmx{heap}m", "-XX:+UseSerialGC", "-XX:ActiveProcessorCount=1", "--add-modules", "jdk.incubator.vector"]
            self.child = subprocess.Popen([java, *options, source], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            try:
                self._send(struct.pack(">4i", *z.shape, *reach), z.astype(">f8").tobytes(), tower.astype(">f8").tobytes(), struct.pack(">d", whole_height(z, tower)))
                if self.child.stdout.read(1) != b"\1":
                    raise OSError("java did not start")
            except OSError:
                self.close()
                raise

    def _send(self, *parts: bytes) -> None:
        for part in parts:
            self.child.stdin.write(part)
        self.child.stdin.flush()

    def block(self, asked: np.ndarray, top: int, left: int) -> np.ndarray:
        """Flags per row offset, column offset, row and column of the block; observers that are not ``asked`` may hold anything."""
        self._send(struct.pack(">4i", top, left, *asked.shape), np.ascontiguousarray(asked, np.uint8).tobytes())
        high, wide = asked.shape
        shape = 2 * self.reach[0] + 1, 2 * self.reach[1] + 1
        seen = self._bits(*shape, high, wide)
        seen |= self._bits(*shape, wide, high).transpose(0, 1, 3, 2)
        return seen.view(bool)

    def _bits(self, *shape: int) -> np.ndarray:
        size = 8 * math.prod(shape[:3])
        raw = self.child.stdout.read(size)
        if len(raw) < size:
            raise RuntimeError("the process that walks rays ended")
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(*shape[:3], 8), axis=3, count=shape[3], bitorder="little")

    def close(self) -> None:
        for pipe in (self.child.stdin, self.child.stdout):
            try:
                pipe.close()
            except OSError:
                pass
        self.child.wait()
