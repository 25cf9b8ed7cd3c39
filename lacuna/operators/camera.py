"""An orbit camera in float32, on the driver; plans get only its matrix as literals.

Matrices are numpy arrays by row and column; vectors are columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

f32 = np.float32
UP = np.array([0, 0, 1], f32)
# Fixed values of the view model.
PITCH_LIMIT = f32(np.radians(89))
FIT, NEAR_SHARE, NEAREST, ZOOM_RATE = f32(1.15), f32(0.005), f32(1e-4), f32(0.15)
CLOSEST_SHARE, FARTHEST_SHARE, FAR_DEPTH = f32(1e-3), f32(500), f32(0.999999)


def unit(v: np.ndarray) -> np.ndarray:
    """The direction of a vector; one of no length stays zero."""
    n = f32(np.sqrt(np.dot(v, v)))
    return (v / n).astype(f32) if n > 1e-20 else np.zeros(3, f32)


def look_at(eye: np.ndarray, target: np.ndarray, up: np.ndarray = UP) -> np.ndarray:
    """World to eye space, right-handed: the camera looks along its -z."""
    ahead = unit(target - eye)
    side = unit(np.cross(ahead, up))
    axes = np.stack([side, np.cross(side, ahead), -ahead])
    out = np.eye(4, dtype=f32)
    out[:3, :3], out[:3, 3] = axes, -axes @ eye
    return out


def perspective(fov_y: float, aspect: float, near: float, far: float) -> np.ndarray:
    """Clip depth runs from 0 at the near plane to 1 at the far one."""
    scale = 1 / np.tan(fov_y / 2)
    depth = far / (near - far)
    out = np.zeros((4, 4), f32)
    out[0, 0], out[1, 1], out[2, 2], out[2, 3], out[3, 2] = scale / aspect, scale, depth, near * depth, -1
    return out


def inverse(m: np.ndarray) -> np.ndarray | None:
    """None where the matrix has (nearly) no volume."""
    return None if abs(np.linalg.det(m.astype(np.float64))) < 1e-30 else np.linalg.inv(m.astype(np.float64)).astype(f32)


@dataclass
class OrbitCamera:
    width: int = 1
    height: int = 1
    fov_y: float = float(np.radians(50))
    yaw: float = float(np.radians(45))
    pitch: float = float(np.radians(30))
    distance: float = 10.0
    pivot: np.ndarray = field(default_factory=lambda: np.zeros(3, f32))
    radius: float = 1.0
    closest: float = 1e-3
    farthest: float = 500.0

    def set_viewport(self, width: int, height: int) -> None:
        self.width, self.height = max(1, width), max(1, height)

    @property
    def aspect(self) -> float:
        return self.width / self.height

    def frame(self, low, high) -> None:
        """See the whole box: its sphere fits the narrower field of view."""
        low, high = np.asarray(low, f32), np.asarray(high, f32)
        self.pivot = (low + high) / f32(2)
        self.radius = max(float(np.linalg.norm(high - low)) / 2, 1e-3)
        fov_x = 2 * np.arctan(np.tan(self.fov_y / 2) * self.aspect)
        half = max(min(self.fov_y, fov_x) / 2, 1e-3)
        self.distance = float(f32(self.radius / np.sin(half)) * FIT)
        self.closest, self.farthest = float(self.radius * CLOSEST_SHARE), float(self.radius * FARTHEST_SHARE)

    @property
    def near(self) -> float:
        return float(max(f32(self.distance) * NEAR_SHARE, NEAREST))

    @property
    def far(self) -> float:
        return max(self.distance + 4 * self.radius, 2 * self.distance)

    def outward(self) -> np.ndarray:
        c = np.cos(self.pitch)
        return np.array([c * np.cos(self.yaw), c * np.sin(self.yaw), np.sin(self.pitch)], f32)

    def forward(self) -> np.ndarray:
        return unit(-self.outward())

    def eye(self) -> np.ndarray:
        return self.pivot + self.outward() * f32(self.distance)

    def right(self) -> np.ndarray:
        return unit(np.cross(self.forward(), UP))

    def up(self) -> np.ndarray:
        return np.cross(self.right(), self.forward())

    def view(self) -> np.ndarray:
        return look_at(self.eye(), self.pivot)

    def projection(self) -> np.ndarray:
        return perspective(self.fov_y, self.aspect, self.near, self.far)

    def matrix(self) -> np.ndarray:
        return self.projection() @ self.view()

    def orbit(self, right_px: float, up_px: float) -> None:
        """A drag over the whole width is half a turn."""
        turn = np.pi / self.width
        self.yaw -= right_px * turn
        self.pitch = float(np.clip(self.pitch + up_px * turn, -PITCH_LIMIT, PITCH_LIMIT))

    def pan(self, right_px: float, up_px: float) -> None:
        """A drag moves the pivot by as many pixels at its depth."""
        metres = 2 * self.distance * np.tan(self.fov_y / 2) / self.height
        self.pivot = (self.pivot - self.right() * f32(right_px * metres) - self.up() * f32(up_px * metres)).astype(f32)

    def zoom(self, ticks: float) -> None:
        self.distance = float(np.clip(self.distance * np.exp(-ticks * ZOOM_RATE), self.closest, self.farthest))

    def set_pivot_keeping_eye(self, pivot) -> None:
        pivot = np.asarray(pivot, f32)
        away = self.eye() - pivot
        d = float(np.linalg.norm(away))
        if d < 1e-6:
            return
        self.pivot, self.distance = pivot, float(np.clip(d, self.closest, self.farthest))
        self.yaw = float(np.arctan2(away[1], away[0]))
        self.pitch = float(np.clip(np.arcsin(np.clip(away[2] / d, -1, 1)), -PITCH_LIMIT, PITCH_LIMIT))

    def pixel_to_ndc(self, x: float, y_up: float) -> tuple[float, float]:
        return 2 * x / self.width - 1, 2 * y_up / self.height - 1

    def unproject(self, x: float, y: float, depth: float) -> np.ndarray | None:
        """The world point of a depth reading; None where nothing was drawn."""
        back = inverse(self.matrix())
        if depth >= FAR_DEPTH or back is None:
            return None
        p = back @ np.array([x, y, depth, 1], f32)
        return None if abs(p[3]) < 1e-12 else p[:3] / p[3]
